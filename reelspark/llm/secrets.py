"""Secret scans judged by corpus-wide ownership frequency.

Candidates are found by pattern in every text. The digest of each candidate value is counted over the corpus by
distinct repositories and distinct owners: a value that many owners hold is a copied example, a value that few hold
looks live. Bare tokens without a telling context count as secrets only where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.shared import fresh, span_arrays, text_of, uncovered, written

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs of token characters; those with too little variety are no candidates.
BARE = r"[A-Za-z0-9+/_=-]{24,}"
#: What texts with candidates hold at least: searched in every text, so alternatives start only where they can.
TOLD = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24}"
KINDS = ("assign", "access", "hex", "bare")
#: A value held by more owners than this is a copied example.
MAX_OWNERS = 3
#: Different characters that a bare token has at least.
MIN_VARIETY = 8

FINDING = "struct<start:int,rank:int,stop:int,kind:string,digest:string,verdict:string,owners:bigint,repositories:bigint>"


def _hit(text: Column) -> Column:
    """Whether a text may hold a candidate."""
    return ((text.contains(":") | text.contains("=")) & text.rlike(TOLD)) | text.contains("AKIA") | text.rlike(RUN)


def _spans(text: Column) -> Column:
    """array<struct<start, rank, stop, kind, digest>>: the spans of all kinds."""

    def kind(rank: int, found: Column, value) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(KINDS[rank]).alias("kind"), F.sha2(value(s["value"]), 256).alias("digest")),
        )

    secret = lambda v: F.regexp_extract(v, ASSIGN, 2)
    same = lambda v: v
    assign = kind(0, F.filter(span_arrays(text, ASSIGN), lambda s: F.length(secret(s["value"])) >= 6), secret)
    varied = lambda v: v.rlike("[A-Za-z]") & v.rlike("[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_VARIETY)
    bare = kind(3, F.filter(span_arrays(text, BARE), lambda s: varied(s["value"])), same)
    return F.concat(assign, kind(1, span_arrays(text, ACCESS), same), kind(2, span_arrays(text, HEX), same), bare)


def scan(docs: DataFrame, text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with findings: array<struct<start, rank, stop, kind, digest, verdict, owners, repositories>>, by start and kind.

    Positions are code points, stop exclusive. verdict is 'live' for a value of at most max_owners owners and 'example'
    for others; bare findings are always live. Null texts count as empty and have no findings; null owners or
    repositories count as one owner or repository. Every row is kept, repeated rows too; a column of docs named
    findings is replaced.
    """
    docs = docs.drop("findings")
    row, spans = fresh(docs, "row"), fresh(docs, "spans")
    text = text_of(text_col)
    hit = _hit(text)
    # The few rows that may hold something are written once, so that their row numbers hold in each later use.
    few = written(docs.where(hit).withColumns({spans: _spans(text), row: F.monotonically_increasing_id()}), "secrets")
    key = lambda c: F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("\0")), 256)
    each = few.select(row, key(owner_col).alias("own"), key(repository_col).alias("repo"), F.explode(spans).alias("s"))
    # Bare tokens count where no base span overlaps them.
    each = uncovered(each.select(row, "own", "repo", "s", F.col("s.digest").alias("digest"), "s.start", "s.stop", (F.col("s.rank") < 3).alias("base")), row, "base")
    # Distinct (value, owner, repository) first: a value in a third of all rows is summed before its rows meet.
    held = each.select("digest", "own", "repo").distinct().groupBy("digest", "own").agg(F.count("*").alias("n"))
    stats = held.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    verdict = F.when(F.col("owners") <= max_owners, "live").otherwise("example")
    judged = (
        each.select(row, "s", "digest").join(stats, "digest")
        .where((F.col("s.rank") < 3) | (F.col("owners") <= max_owners))
        .groupBy(row)
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.stop", "s.kind", "s.digest", verdict.alias("verdict"), "owners", "repositories"))).alias("findings"))
    )
    none = F.array().cast(f"array<{FINDING}>")
    with_some = few.join(judged, row, "left").select(*docs.columns, F.coalesce("findings", none).alias("findings"))
    return with_some.unionByName(docs.where(~hit).withColumn("findings", none))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """found with the live findings in its text replaced by [kind]; overlapping ones are joined, the first naming it."""
    live = F.filter("findings", lambda f: f["verdict"] == "live")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walk = F.aggregate(
        live,
        start,
        lambda acc, f: F.when(
            f["start"] < acc["at"],
            F.struct(F.greatest(acc["at"], f["stop"]).alias("at"), acc["out"].alias("out")),
        ).otherwise(
            F.struct(f["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), F.lit("["), f["kind"], F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size(live) > 0, walk).otherwise(text))
