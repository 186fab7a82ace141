"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) expression whose path length occurs among the rules;
expressions meet the rules by an equi-join on a short hash prefix, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.shared import fresh

#: Hex digits of the short hash on which URLs and rules are joined.
SHORT = 8
#: A rule set up to so many rows (about 100 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (any columns of these names are replaced).

    rules has host, path (beginning with /) and verdict ('allow' or 'block'). A rule fits its host and all
    subdomains, if the path starts with its path. The longest host+path wins; of equally long ones the longer
    host, then 'block'. Without a fitting rule, rule is null and the verdict is `default`. Null and malformed
    urls have an empty host and path, which no rule fits. Repeated rows stay; rules with nulls fit nothing; an
    empty rule set leaves the default; no page table is too small.
    """
    keep = pages.drop("host", "path", "rule", "verdict")
    u = fresh(keep, "u")
    # Path lengths are a property of the rules, at most as many as the longest rule path has characters. Host suffixes
    # are as long as some rule host at most, however many labels a url has.
    rules = rules.select("host", "path", "verdict").dropna()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    digests = rules.select(
        F.sha2(F.concat("host", "path"), 256).alias("digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("n_host"),
            F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
            F.concat("host", "path").alias("rule"), "verdict",
        ).alias("hit"),
    ).withColumn("short", F.substring("digest", 1, SHORT))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        digests = F.broadcast(digests)

    urls = keep.select(F.col(url_col).alias(u)).where(F.col(u).isNotNull()).distinct()
    parts = urls.withColumns({"host": host_of(F.col(u)), "path": path_of(F.col(u))})
    hosts = F.array_distinct(F.expr(f"transform(sequence(1, {max(labels, 1)}), i -> substring_index(host, '.', -i))"))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    hits = (
        parts.select(u, F.explode(F.transform(expressions, lambda e: F.sha2(e, 256))).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
        .join(digests.withColumnRenamed("digest", "full"), "short")
        .where(F.col("digest") == F.col("full"))
        .groupBy(u)
        .agg(F.max("hit").alias("hit"))
    )
    hit = fresh(keep, "hit")
    out = keep.join(hits.select(F.col(u), F.col("hit").alias(hit)), keep[url_col] == F.col(u), "left")
    return out.select(
        *[keep[c] for c in keep.columns],
        host_of(keep[url_col]).alias("host"),
        path_of(keep[url_col]).alias("path"),
        F.col(f"{hit}.rule").alias("rule"),
        F.coalesce(F.col(f"{hit}.verdict"), F.lit(default)).alias("verdict"),
    )
