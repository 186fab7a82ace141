"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import chat, conversation_repair, decontaminate, fingerprint, jaccard_join, language_id, merkle_manifest, mixing, pii, secrets, token_files, toxicity, url_filter
from reelspark.llm.shared import shared_dir, table

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
  SELECT page_id, url,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
hits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.n = h.n AND h.k = 1
"""

#: Target shares of the sources, of 47 in all: the first sources are the wanted ones, all others share the rest.
MIX_SHARES = {f"src{i}": 6 - i // 2 for i in range(10)} | {f"src{i}": 1 for i in range(10, 16)}
MIX_REST = 1
MIX_BLOCK = 16


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_SHARES, MIX_REST, MIX_BLOCK)


OP4_SQL = f"""
WITH RECURSIVE shares AS (
  SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', {s})" for i, (n, s) in enumerate([*((n, MIX_SHARES[n]) for n in sorted(MIX_SHARES)), ('*', MIX_REST)]))}) AS t(s, name, share)),
edf(t, done, chosen) AS (
  SELECT -1, list_transform(range({len(MIX_SHARES) + 1}), lambda x: 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i - 1 = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT t, done, (SELECT s FROM shares WHERE done[s + 1] * {sum(MIX_SHARES.values()) + MIX_REST} // share <= t + 1
      ORDER BY ceil((done[s + 1] + 1) * {sum(MIX_SHARES.values()) + MIX_REST} / share), s LIMIT 1) AS pick
    FROM edf WHERE t < {sum(MIX_SHARES.values()) + MIX_REST - 1})),
period AS (SELECT chosen AS s, t AS slot, row_number() OVER (PARTITION BY chosen ORDER BY t) - 1 AS nth FROM edf WHERE t >= 0),
numbered AS (
  SELECT d.doc_id, d.source, coalesce(h.s, {len(MIX_SHARES)}) AS s,
    row_number() OVER (PARTITION BY coalesce(h.s, {len(MIX_SHARES)}) ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id) - 1 AS n
  FROM documents d LEFT JOIN shares h ON d.source = h.name AND h.name <> '*')
SELECT n.doc_id, n.source, h.name AS stream, (n.n // {MIX_BLOCK})::BIGINT AS block,
  ((n.n // {MIX_BLOCK}) // h.share * {sum(MIX_SHARES.values()) + MIX_REST} + p.slot)::BIGINT AS slot, (n.n % {MIX_BLOCK})::BIGINT AS place_in_block
FROM numbered n JOIN shares h USING (s) JOIN period p ON p.s = n.s AND p.nth = (n.n // {MIX_BLOCK}) % h.share
"""


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs).select("doc_id", "findings")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("findings", lambda f: f["rank"] < 3)), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        F.array_join(F.transform("findings", lambda f: f["verdict"]), ",").alias("verdicts"),
    )


def _any_case(words: str) -> str:
    """A regular expression's letters in either case, as classes."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = r"""(?:NAMES)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("NAMES", _any_case("password|passwd|secret|token|api_?key"))
_LISTED = ["assign", "access", "hex", "bare"]
_FOUND = " UNION ALL ".join(
    f"SELECT n, {k} AS rank, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"
    for k, p in enumerate((_ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+"), secrets.ACCESS, secrets.HEX, secrets.BARE))
)
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
placed AS (
  SELECT n, rank, f[i] AS v, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::BIGINT AS a
  FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM found)),
valued AS (SELECT n, rank, a, a + length(v) AS z, CASE WHEN rank = 0 THEN regexp_extract(v, '{_ASSIGN}', 1) ELSE v END AS v FROM placed),
base AS (SELECT * FROM valued WHERE (rank = 0 AND length(v) >= 6) OR rank IN (1, 2)),
bare AS (
  SELECT * FROM valued b WHERE rank = 3 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= {secrets.MIN_VARIETY}
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.n = b.n AND x.a < b.z AND b.a < x.z)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM spans JOIN d USING (n) GROUP BY 1),
kept AS (SELECT *, ({_LISTED})[rank + 1] || ':' || a || ':' || z AS said, CASE WHEN owners <= {secrets.MAX_OWNERS} THEN 'live' ELSE 'example' END AS verdict FROM spans JOIN owned USING (v) WHERE rank < 3 OR owners <= {secrets.MAX_OWNERS}),
told AS (
  SELECT n, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(said, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS b, string_agg(said, ',' ORDER BY a, rank) AS spans, list(verdict ORDER BY a, rank) AS verdicts
  FROM kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
  array_to_string(coalesce(verdicts, []), ',') AS verdicts
FROM d LEFT JOIN told USING (n)
"""


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(joined(F.filter("pii", lambda s: s["rank"] < 4)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


_PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
_PII_FOUND = " UNION ALL ".join(f"SELECT n, {k} AS rank, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')" for k, p in enumerate(_PII))
_PLACED = "(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::BIGINT"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_PII_FOUND}),
placed AS (SELECT n, rank, f[i] AS v, {_PLACED} AS a FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM found)),
digits AS (SELECT *, a + length(v) AS z, regexp_replace(v, '[^0-9]', '', 'g') AS o FROM placed),
base AS (
  SELECT * FROM digits WHERE rank = 0
    OR (rank = 1 AND list_bool_and(list_transform(string_split(v, '.'), lambda x: x::HUGEINT <= 255)))
    OR (rank = 2 AND length(o) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(o), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x > '4' THEN x::INT * 2 - 9 ELSE x::INT * 2 END)) % 10 = 0)
    OR (rank = 3 AND length(o) BETWEEN 8 AND 15)),
entity AS (SELECT b.n, b.a, b.z, b.rank || ':' || CASE WHEN b.rank = 0 THEN lower(v) ELSE o END AS e, t FROM base b JOIN d USING (n)),
windows AS (
  SELECT n, e, greatest(a - {pii.NEAR}, 0) AS off, substr(t, greatest(a - {pii.NEAR}, 0) + 1, a - greatest(a - {pii.NEAR}, 0)) AS w, a > {pii.NEAR} AS cut_left, false AS cut_right FROM entity
  UNION ALL SELECT n, e, z, substr(t, z + 1, {pii.NEAR}), false, length(t) > z + {pii.NEAR} FROM entity),
words AS (SELECT n, e, off, w, cut_left, cut_right, f[i] AS v, {_PLACED} AS a FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM (
  SELECT *, regexp_extract_all(w, '\p{{L}}{{3,}}|\p{{Han}}{{2}}') AS f, string_split_regex(w, '\p{{L}}{{3,}}|\p{{Han}}{{2}}') AS g FROM windows WHERE regexp_matches(w, '\p{{L}}{{3,}}|\p{{Han}}{{2}}')))),
beside AS (SELECT n, e, off + a AS a, off + a + length(v) AS z, lower(v) AS w FROM words WHERE NOT (cut_left AND a = 0) AND NOT (cut_right AND a + length(v) = length(w))),
n_e AS (SELECT e, count(DISTINCT n) AS n_e FROM entity GROUP BY 1),
held AS (SELECT DISTINCT n, unnest(string_split_regex(lower(t), '[^\p{{L}}]+')) AS w FROM d WHERE n IN (SELECT n FROM entity)),
together AS (
  SELECT e, w, count(*) AS n_te FROM (SELECT DISTINCT n, e FROM entity) JOIN held USING (n) SEMI JOIN (SELECT DISTINCT e, w FROM beside) USING (e, w)
  GROUP BY 1, 2 HAVING count(*) >= {pii.MIN_TOGETHER}),
n_t AS (SELECT w, count(DISTINCT n) AS n_t FROM (SELECT n, unnest(string_split_regex(lower(t), '[^\p{{L}}]+')) AS w FROM d) WHERE w IN (SELECT w FROM together) GROUP BY 1),
shares AS (
  SELECT e, w, CASE WHEN n_e >= c THEN 0 ELSE ln(c::DOUBLE * n_te / (n_t * n_e)) / ln(c::DOUBLE / n_e) END AS share
  FROM together JOIN n_t USING (w) JOIN n_e USING (e), (SELECT count(*) AS c FROM documents)),
terms AS (SELECT n, a, z, CASE WHEN max(share) > {pii.REMOVE_SHARE} THEN 4 ELSE 5 END AS rank FROM beside JOIN shares USING (e, w) WHERE share > {pii.GENERALISE_SHARE} GROUP BY n, a, z),
spans AS (SELECT n, rank, a, z FROM base UNION ALL SELECT n, rank, a, z FROM terms x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = x.n AND b.a < x.z AND x.a < b.z)),
told AS (
  SELECT n, count(*) FILTER (WHERE rank = 0) AS n_email, count(*) FILTER (WHERE rank = 1) AS n_ip, count(*) FILTER (WHERE rank = 2) AS n_card, count(*) FILTER (WHERE rank = 3) AS n_phone,
    string_agg(said, ',' ORDER BY rank, a) FILTER (WHERE rank < 4) AS b, string_agg(said, ',' ORDER BY rank, a) AS spans
  FROM (SELECT *, ({list(pii.KINDS)})[rank + 1] || ':' || a || ':' || z AS said FROM spans) GROUP BY n)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (n)
"""


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT n, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
c AS (SELECT n, count(*) AS k FROM s GROUP BY n),
p AS (SELECT a.n AS x, b.n AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.n <> b.n GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c a ON a.n = x JOIN c b ON b.n = y WHERE 100 * i >= 75 * (a.k + b.k - i)),
r(n, m) AS (SELECT n, n FROM d UNION SELECT r.n, l.y FROM r JOIN l ON r.m = l.x)
SELECT any_value(d.doc_id) AS doc_id, any_value(coalesce(c.k, 0))::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN r ON r.n = d.n JOIN d e ON e.n = r.m LEFT JOIN c ON c.n = d.n GROUP BY d.n
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(docs.where(fold != 1))
    out = language_id.predict(docs, model)
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("tree"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "tree bigint, turn bigint, role string, text string")
    out = chat.format_paths(chat.paths(chat.chain(turns.unionByName(probe))))
    read = out.withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace(coalesce(text, ''), '([<\[])(\x{2060}*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|unk>|pad>|bos>|eos>|start_of_turn>|end_of_turn>|\|[A-Za-z0-9_]+\|>)', '\1' || chr(8288) || '\2\3', 'g')"
OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length({_ESCAPED}) + {len(chat.OPEN) + len(chat.CLOSE) + 2})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and the root that its leaf or its tampered one gives; a null id is never tampered with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = ["doc_id", "source", "lang", "n_chars"]
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(changed, merkle_manifest.leaf([*columns, F.replace("text", F.lit("\n"), F.lit(""))]))
    found = merkle_manifest.manifest(docs.withColumn("tampered", tampered), [*columns, "text"], "source", "doc_id", ["doc_id", "tampered"])
    out = found.withColumn("folded_root", merkle_manifest.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: (ascii(substr({text}, i, 1)) >> k) & 1)))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295)"


_SAID = lambda values: " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)
_LEAF = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]
OP11_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256({_SAID([*_LEAF, "text"])}) AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_SAID([*_LEAF, "replace(text, chr(10), '')"])}) END AS tampered FROM documents)),
up(lvl, g, pos, n, digest) AS (
  SELECT 0, g, pos, n, leaf FROM d
  UNION ALL SELECT lvl + 1, g, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, g, pos // 3, (n + 2) // 3),
sub AS (SELECT g, digest, count(*) OVER () AS n FROM up WHERE n = 1),
high(lvl, pos, n, digest) AS (
  SELECT 0, g, n, digest FROM sub
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3, (n + 2) // 3),
runs AS (SELECT lvl, g, pos // 3 AS parent, list(digest ORDER BY pos) AS ds FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT lvl, -1, pos // 3, list(digest ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
walk(i, g, lvl, pos, n, folded, sibs, own) AS (
  SELECT i, g, 0, pos, n, coalesce(tampered, leaf), '', g FROM d
  UNION ALL
  SELECT w.i, CASE WHEN w.n = 1 THEN -1 ELSE w.g END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END, CASE WHEN w.n = 1 THEN w.own ELSE w.pos // 3 END,
    CASE WHEN w.n = 1 THEN (SELECT count(*) FROM sub) ELSE (w.n + 2) // 3 END,
    CASE WHEN w.n = 1 THEN w.folded ELSE sha256(array_to_string(r.ds[:w.pos % 3], '') || w.folded || array_to_string(r.ds[w.pos % 3 + 2:], '')) END,
    CASE WHEN w.n = 1 THEN w.sibs ELSE w.sibs || array_to_string(r.ds[:w.pos % 3], '') || array_to_string(r.ds[w.pos % 3 + 2:], '') END, w.own
  FROM walk w LEFT JOIN runs r ON r.g = w.g AND r.lvl = w.lvl AND r.parent = w.pos // 3 WHERE w.n > 1 OR w.g >= 0)
SELECT d.doc_id, d.leaf, s.digest AS subroot, h.digest AS root, sha256(w.sibs) AS proof_sha256, w.folded AS folded_root, w.folded = h.digest AS verified
FROM d JOIN walk w ON w.i = d.i AND w.g = -1 AND w.n = 1 JOIN sub s ON s.g = d.g CROSS JOIN (SELECT digest FROM high WHERE n = 1) h
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after damage; in the damage key a null turn or id is one space like other nulls."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.explode(F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    damaged = turns.where(damage != 0).select("conv_id", "turn", F.when(damage == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")
    audits = conversation_repair.repair(damaged)
    shas = conversation_repair.digests(conversation_repair.repaired(damaged, audits))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(audits, F.col("id").eqNullSafe(audits["conv_id"]), "left").drop("conv_id")
    out = out.join(shas, F.col("id").eqNullSafe(shas["conv_id"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return out.select(
        F.col("id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_NONE = "{'c': 1000000, 'l': '', 'o': ''}"
#: A path's struct c (cost), l (labels), o (rows so far), with one edit more.
_EDIT = lambda p, cost, label, row="''": f"{{'c': {p}.c + {cost}, 'l': {p}.l || '{label}', 'o': {p}.o || {row}}}"
_LEAST = lambda *ps: f"list_min([{', '.join(ps)}])"
_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_KEPT, _AS_USER, _AS_ASSISTANT = "role || ':' || text || chr(10)", "'user:' || text || chr(10)", "'assistant:' || text || chr(10)"
_IF = lambda test, path: f"CASE WHEN {test} THEN {path} ELSE {_NONE} END"
_STAYS, _COST = "fault NOT IN ('blank', 'duplicate')", "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
OP12_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS time FROM raw WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i FROM hurt),
rows_ AS (
  SELECT *, substr(role, 1, 1) AS x,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
best(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'l': '', 'o': ''}}, {_NONE}, {_NONE}, {_NONE} FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT conv_id, i, {_EDIT('z', 3, 'D')}, {_LEAST(_EDIT('s', 3, 'D'), _IF(f"x = 's' AND {_STAYS}", _EDIT('z', _COST, 'K', _KEPT)))},
    {_LEAST(_EDIT('v', 3, 'D'), *[_IF(_STAYS, _EDIT(q, '2 + ' + _COST, 'R', _AS_USER)) for q in ('z', 's', 'b')], *[_IF(f"x = 'u' AND {_STAYS}", _EDIT(q, _COST, 'K', _KEPT)) for q in ('z', 's', 'b')])},
    {_LEAST(_EDIT('b', 3, 'D'), _IF(_STAYS, _EDIT('v', '2 + ' + _COST, 'R', _AS_ASSISTANT)), _IF(f"x = 'a' AND {_STAYS}", _EDIT('v', _COST, 'K', _KEPT)))}
  FROM (
    SELECT *, {_LEAST('a', _EDIT('v', 2, 'I', _ASSISTANT))} AS b FROM (
      SELECT r.conv_id, r.i, r.role, r.text, r.x, r.fault, p.z, p.s, p.a, {_LEAST('p.u', *[_EDIT('p.' + q, 2, 'I', _USER) for q in 'zsa'])} AS v
      FROM best p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
ended AS (
  SELECT conv_id, {_LEAST('z', 'a', _EDIT(_LEAST('u', *[_EDIT(q, 2, 'I', _USER) for q in 'zsa']), 2, 'I', _ASSISTANT))} AS p
  FROM best WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM best GROUP BY conv_id)),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(p.c, 0)::BIGINT AS cost, coalesce(p.l, '') AS audit, sha256(coalesce(left(p.o, greatest(length(p.o) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, sizes and checksums of all documents' ids, read back from the files; special tokens' strings are what the library makes of them by default."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    encoded = token_files.encode(table(spark, sf_dir, "documents"), tokenizer, end=0, special_as_text=False)
    token_files.write(encoded, folder, token_files.vocabulary(tokenizer))
    return token_files.read(spark, folder, "crc32")
