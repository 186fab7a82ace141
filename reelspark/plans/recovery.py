"""Queries of activation, configurations in mid-stream, error latches, rollback, canvas disposal and inverse transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import intra, raster, residual
from reelspark.operators import recovery
from reelspark.sources.views import PIXELS_SQL, pixels, sql, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def parameter_activation(spark, d):
    """Sets come at every ninth picture, of few contents, so that some come again unchanged."""
    x = view(spark, d, "slices").withColumn("kind", F.when(C("n") % 9 < 2, "set").otherwise("slice"))
    content = F.when(C("kind") == "set", F.floor(C("n") / 45) % 3)
    return recovery.activations(x.select("stream_id", "n", "kind", "set_id", content.alias("content"), (C("idr") | (C("n") % 11 == 0)).alias("idr")))


QUERIES["parameter_activation"] = parameter_activation
ORACLE_SQL["parameter_activation"] = f"""WITH RECURSIVE {sql('slices')},
e AS (SELECT stream_id, n, n % 9 < 2 AS is_set, set_id, n // 45 % 3 AS content, idr OR n % 11 = 0 AS idr, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i FROM slices),
step(stream_id, i, n, is_set, set_id, idr, held, brought, a_id, a_n, verdict, set_n) AS (
  SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, true, 0::BIGINT, false, [NULL, NULL, NULL, NULL]::BIGINT[], [NULL, NULL, NULL, NULL]::BIGINT[], NULL::BIGINT, NULL::BIGINT, '', NULL::BIGINT FROM e
  UNION ALL
  SELECT stream_id, i, n, is_set, set_id, idr, CASE WHEN changed THEN list_transform(held, lambda x, k: CASE WHEN k = set_id + 1 THEN content ELSE x END) ELSE held END,
    CASE WHEN changed THEN list_transform(brought, lambda x, k: CASE WHEN k = set_id + 1 THEN n ELSE x END) ELSE brought END,
    CASE WHEN takes THEN set_id ELSE a_id END, CASE WHEN takes THEN stored ELSE a_n END,
    CASE WHEN is_set THEN '' WHEN stored IS NULL THEN 'missing' WHEN takes AND NOT same THEN 'activated' WHEN same THEN 'ok' ELSE 'refused' END, CASE WHEN stored IS NOT NULL AND (takes OR same) THEN stored END
  FROM (SELECT *, is_set AND held[set_id + 1] IS DISTINCT FROM content AS changed, NOT is_set AND stored IS NOT NULL AND (idr OR a_n IS NULL) AS takes, coalesce(a_id = set_id AND a_n = stored, false) AS same
    FROM (SELECT s.*, p.held, p.brought, p.a_id, p.a_n, p.brought[s.set_id + 1] AS stored FROM step p JOIN e s ON s.stream_id = p.stream_id AND s.i = p.i + 1)))
SELECT stream_id, n, set_id, idr, verdict, set_n FROM step WHERE i > 0 AND NOT is_set"""


def configuration_switches(spark, d):
    """Units between configuration records that come in mid-stream; every third record is refused."""
    x = view(spark, d, "records").select("stream_id", C("seq").alias("n"), "kind", "bytes")
    units = x.where("kind = 'UNIT'").select("stream_id", "n", F.hex(C("bytes")).alias("body"))
    told = lambda v, m: F.concat(F.lit(v), F.lpad(F.hex(F.floor(C("n") / 10) % m), 2, "0"))
    records = x.where("kind = 'STREAM'").select("stream_id", "n", (F.floor(C("n") / 10) % 4 + 1).cast("int").alias("nal_length"), told("67", 2).alias("sps"), told("68", 3).alias("pps"), (C("n") % 3 > 0).alias("adopted"))
    return recovery.bind_configurations(units, records)


QUERIES["configuration_switches"] = configuration_switches
ORACLE_SQL["configuration_switches"] = f"""WITH {sql('records')},
c AS (SELECT stream_id, seq AS n, (seq // 10 % 4 + 1)::INT AS nal_length, '67' || printf('%02X', seq // 10 % 2) AS sps, '68' || printf('%02X', seq // 10 % 3) AS pps FROM records WHERE kind = 'STREAM' AND seq % 3 > 0),
u AS (SELECT u.stream_id, u.seq AS n, printf('%X', u.bytes) AS body, c.n AS config_n, c.nal_length, c.sps || c.pps AS pair
  FROM (SELECT * FROM records WHERE kind = 'UNIT') u ASOF LEFT JOIN c ON u.stream_id = c.stream_id AND u.seq >= c.n)
SELECT stream_id, n, body, config_n, nal_length, CASE WHEN pair IS NULL THEN NULL WHEN pair IS DISTINCT FROM lag(pair) OVER (PARTITION BY stream_id ORDER BY n) THEN pair ELSE '' END AS sets FROM u"""


def error_latch(spark, d):
    """Units of streams: a truncated one sets the latch, the next record that opens a stream clears it."""
    x = view(spark, d, "records").withColumnRenamed("seq", "n")
    return recovery.latched(x, ["stream_id"], C("truncated"), C("kind") == "STREAM").select("stream_id", "n", "kind", "kept", "faults", "fresh")


QUERIES["error_latch"] = error_latch
ORACLE_SQL["error_latch"] = f"""WITH RECURSIVE {sql('records')}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i FROM records),
step(stream_id, i, n, kind, kept, faults, fresh) AS (
  SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, '', true, 0::BIGINT, false FROM r
  UNION ALL
  SELECT r.stream_id, r.i, r.seq, r.kind, CASE WHEN r.truncated THEN false WHEN r.kind = 'STREAM' THEN true ELSE p.kept END, p.faults + CASE WHEN r.truncated THEN 1 ELSE 0 END, NOT p.kept AND NOT r.truncated AND r.kind = 'STREAM'
  FROM step p JOIN r ON r.stream_id = p.stream_id AND r.i = p.i + 1)
SELECT stream_id, n, kind, kept, faults, fresh FROM step WHERE i > 0"""


def unit_rollback(spark, d):
    """Bytes that a stream's decoder has taken, with units that are cut or never end taken back."""
    x = view(spark, d, "records").select("stream_id", C("seq").alias("n"), (C("seq") % 4 != 2).alias("starts"), C("truncated").alias("cut"), (~C("continues")).alias("ends"), "bytes")
    return recovery.rolled_back(x).select("stream_id", "n", "counted", "snapshot", "state")


QUERIES["unit_rollback"] = unit_rollback
ORACLE_SQL["unit_rollback"] = f"""WITH RECURSIVE {sql('records')},
r AS (SELECT *, seq % 4 <> 2 AS starts, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i, lead(seq % 4 <> 2, 1, true) OVER (PARTITION BY stream_id ORDER BY seq) AS closes FROM records),
step(stream_id, i, n, snapshot, state, broken, unit, whole) AS (
  SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true, 0::BIGINT, false FROM r
  UNION ALL
  SELECT stream_id, i, seq, s, CASE WHEN u > 0 THEN CASE WHEN starts THEN s ELSE state END + bytes ELSE 0 END, b, u, closes AND u > 0 AND NOT b AND NOT continues
  FROM (SELECT r.*, p.state, CASE WHEN r.starts THEN CASE WHEN p.whole THEN p.state ELSE p.snapshot END ELSE p.snapshot END AS s, CASE WHEN r.starts THEN r.truncated ELSE p.broken OR r.truncated END AS b, p.unit + CASE WHEN r.starts THEN 1 ELSE 0 END AS u
    FROM step p JOIN r ON r.stream_id = p.stream_id AND r.i = p.i + 1))
SELECT stream_id, n, bool_or(whole) OVER (PARTITION BY stream_id, unit) AS counted, snapshot, state FROM step WHERE i > 0"""


def gif_disposal(spark, d):
    """Canvases of pictures of ten frames, each frame with a place, transparency and one of the four disposals."""
    p = pixels(spark, d)
    inside = (C("x") >= C("img") % 4) & (C("y") >= C("img") % 3) & (C("x") < C("img") % 4 + 5)
    v = F.when(C("r") % 4 != 0, raster.rgb565(C("r"), C("g"), C("b")))
    frames = p.select(F.floor(C("img") / 10).alias("picture"), C("img").alias("frame"), "x", "y", v.alias("v"), inside.alias("inside"), (C("img") * 7 % 4).alias("disposal"))
    return recovery.composed(frames, 9).select("picture", "frame", "x", "y", "shown", "left")


QUERIES["gif_disposal"] = gif_disposal
ORACLE_SQL["gif_disposal"] = f"""WITH {PIXELS_SQL},
f AS (SELECT img // 10 AS picture, img AS frame, x, y, CASE WHEN r % 4 <> 0 THEN (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) END AS v, x >= img % 4 AND y >= img % 3 AND x < img % 4 + 5 AS inside, img * 7 % 4 AS disposal FROM pixels),
l AS (SELECT picture, x, y, list({{'frame': frame, 'v': v, 'inside': inside, 'disposal': disposal}} ORDER BY frame) AS fs FROM f GROUP BY ALL),
c AS (SELECT picture, x, y, unnest(list_reduce(fs, lambda acc, q: acc || [{{'frame': q.frame,
    'shown': CASE WHEN q.inside AND q.v IS NOT NULL THEN q.v ELSE acc[-1].kept END,
    'kept': CASE WHEN NOT q.inside THEN acc[-1].kept WHEN q.disposal = 2 THEN 9 WHEN q.disposal = 3 OR q.v IS NULL THEN acc[-1].kept ELSE q.v END}}], [{{'frame': NULL::BIGINT, 'shown': 9, 'kept': 9}}])) AS o FROM l)
SELECT picture, o.frame AS frame, x, y, o.shown AS shown, o.kept AS "left" FROM c WHERE o.frame IS NOT NULL"""


def _levels(k: int):
    """The k-th level of a block: small whole numbers of both signs, with many zeros."""
    return F.when((C("w") + 3 * k) % 4 == 0, (C("b0") * (k + 1) + C("b1") * 3 + k) % 15 - 7).otherwise(0).cast("int")


_LEVELS = "[" + ", ".join(f"(CASE WHEN (w + {3 * k}) % 4 = 0 THEN (b0 * {k + 1} + b1 * 3 + {k}) % 15 - 7 ELSE 0 END)" for k in range(16)) + "]"
_SCALE = lambda kind: f"([{', '.join(str(s[kind]) for s in residual.SCALES)}])[qp % 6 + 1] * (1 << (qp // 6)::INT)"


def inverse_transform(spark, d):
    """Residuals of 4 x 4 blocks, of every qp from 0 to 51; the first level of every fifth block is scaled already."""
    x = view(spark, d, "octets").select("object_id", "k", "b0", "b1", "w", ((C("b1") + C("k")) % 52).cast("int").alias("qp"), (C("b2") % 5 == 0).alias("dc_scaled"))
    r = x.select("object_id", "k", "qp", residual.inverse(F.array(*[_levels(k) for k in range(16)]), C("qp"), C("dc_scaled")).alias("r"))
    return r.select("object_id", "k", "qp", F.array_join(C("r").cast("array<string>"), ",").alias("residual"))


QUERIES["inverse_transform"] = inverse_transform
_ZIG = ", ".join(str(residual.ZIGZAG.index(at) + 1) for at in range(16))
ORACLE_SQL["inverse_transform"] = f"""WITH {sql('octets')}, x AS (SELECT object_id, k, (b1 + k) % 52 AS qp, b2 % 5 = 0 AS scaled, {_LEVELS} AS v FROM octets),
q AS (SELECT object_id, k, qp, list_transform(range(0, 16), lambda i: v[([{_ZIG}])[i + 1]] * CASE WHEN i = 0 AND scaled THEN 1 WHEN i // 4 % 2 = 0 AND i % 2 = 0 THEN {_SCALE(0)} WHEN i // 4 % 2 = 1 AND i % 2 = 1 THEN {_SCALE(1)} ELSE {_SCALE(2)} END) AS d FROM x),
h AS (SELECT object_id, k, qp, list_transform(range(0, 16), lambda i: CASE i % 4
  WHEN 0 THEN d[i + 1] + d[i + 3] + d[i + 2] + (d[i + 4] >> 1) WHEN 1 THEN d[i] - d[i + 2] + (d[i + 1] >> 1) - d[i + 3]
  WHEN 2 THEN d[i - 1] - d[i + 1] - ((d[i] >> 1) - d[i + 2]) ELSE d[i - 2] + d[i] - (d[i - 1] + (d[i + 1] >> 1)) END) AS e FROM q),
o AS (SELECT object_id, k, qp, list_transform(range(0, 16), lambda i: (CASE i // 4
  WHEN 0 THEN e[i + 1] + e[i + 9] + e[i + 5] + (e[i + 13] >> 1) WHEN 1 THEN e[i - 3] - e[i + 5] + (e[i + 1] >> 1) - e[i + 9]
  WHEN 2 THEN e[i - 7] - e[i + 1] - ((e[i - 3] >> 1) - e[i + 5]) ELSE e[i - 11] + e[i - 3] - (e[i - 7] + (e[i + 1] >> 1)) END + 32) >> 6) AS r FROM h)
SELECT object_id, k, qp::INT AS qp, CASE WHEN list_min(r) >= -512 AND list_max(r) <= 511 THEN array_to_string(r, ',') END AS residual FROM o"""


def dc_transforms(spark, d):
    """DC values of luma and chroma blocks."""
    x = view(spark, d, "octets").select("object_id", "k", "b0", "b1", "w", ((C("b1") + C("k")) % 52).cast("int").alias("qp"))
    levels = F.array(*[_levels(k) for k in range(16)])
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return x.select("object_id", "k", "qp", text(residual.luma_dc(levels, C("qp"))).alias("luma"), text(residual.chroma_dc(F.slice(levels, 1, 4), C("qp"))).alias("chroma"))


QUERIES["dc_transforms"] = dc_transforms
_SIGNS = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1))
_TERM = lambda i: " + ".join(f"{_SIGNS[i // 4][r] * _SIGNS[i % 4][c]} * v[{residual.ZIGZAG.index(4 * r + c) + 1}]" for r in range(4) for c in range(4))
ORACLE_SQL["dc_transforms"] = f"""WITH {sql('octets')}, x AS (SELECT object_id, k, (b1 + k) % 52 AS qp, {_LEVELS} AS v FROM octets),
t AS (SELECT *, [{', '.join(_TERM(i) for i in range(16))}] AS f, [v[1] + v[2] + v[3] + v[4], v[1] - v[2] + v[3] - v[4], v[1] + v[2] - v[3] - v[4], v[1] - v[2] - v[3] + v[4]] AS c, ([10, 11, 13, 14, 16, 18])[qp % 6 + 1] AS s FROM x)
SELECT object_id, k, qp::INT AS qp, array_to_string(list_transform(f, lambda y: CASE WHEN qp >= 12 THEN y * s * (1 << (qp // 6 - 2)::INT) WHEN qp >= 6 THEN (y * s + 1) >> 1 ELSE (y * s + 2) >> 2 END), ',') AS luma,
  array_to_string(list_transform(c, lambda y: (y * s * (1 << (qp // 6)::INT)) >> 1), ',') AS chroma FROM t"""


_EDGE = lambda k: (C("b0") * (k + 3) + C("b1") * (k * k + 1) + C("w") % 97 * k) % 256
_EDGE_SQL = lambda k: f"(b0 * {k + 3} + b1 * {k * k + 1} + w % 97 * {k}) % 256"


def intra_blocks(spark, d):
    """Predictions of 4 x 4 blocks by each of the nine modes; every eleventh block has nothing above it, every thirteenth nothing to its left."""
    x = view(spark, d, "octets").withColumn("mode", ((C("b2") + C("k")) % 9).cast("int"))
    above = F.when(C("w") % 11 > 0, F.array(*[_EDGE(k).cast("int") for k in range(8)]))
    left = F.when(C("w") % 13 > 0, F.array(*[_EDGE(k).cast("int") for k in range(8, 12)]))
    x = x.select("object_id", "k", "mode", above.alias("above"), left.alias("left"), F.when((C("w") % 11 > 0) & (C("w") % 13 > 0), _EDGE(12).cast("int")).alias("corner"))
    r = x.select("object_id", "k", "mode", intra.predicted(C("mode"), C("above"), C("left"), C("corner")).alias("r"))
    return r.select("object_id", "k", "mode", F.array_join(F.transform("r", lambda v: v.cast("string")), ",").alias("block"))


QUERIES["intra_blocks"] = intra_blocks
_P2, _P3 = "({0} + {1} + 1) >> 1", "({0} + 2 * {1} + {2} + 2) >> 2"
# p(x, -1) is u[x + 2], p(-1, y) is l[y + 2]; both begin with the corner.
ORACLE_SQL["intra_blocks"] = f"""WITH {sql('octets')}, e AS (SELECT row_number() OVER () AS n, object_id, k, (b2 + k) % 9 AS mode, w % 11 > 0 AS has_u, w % 13 > 0 AS has_l,
  [{', '.join(_EDGE_SQL(k) for k in (12, *range(8)))}] AS u, [{', '.join(_EDGE_SQL(k) for k in (12, *range(8, 12)))}] AS l FROM octets),
p AS (SELECT *, i % 4 AS x, i // 4 AS y FROM (SELECT *, unnest(range(16)) AS i FROM e)),
v AS (SELECT n, object_id, k, mode, i, CASE mode
  WHEN 0 THEN CASE WHEN has_u THEN u[x + 2] END WHEN 1 THEN CASE WHEN has_l THEN l[y + 2] END
  WHEN 2 THEN CASE WHEN has_u AND has_l THEN (u[2] + u[3] + u[4] + u[5] + l[2] + l[3] + l[4] + l[5] + 4) >> 3 WHEN has_u THEN (u[2] + u[3] + u[4] + u[5] + 2) >> 2 WHEN has_l THEN (l[2] + l[3] + l[4] + l[5] + 2) >> 2 ELSE 128 END
  WHEN 3 THEN CASE WHEN has_u THEN CASE WHEN i = 15 THEN (u[8] + 3 * u[9] + 2) >> 2 ELSE {_P3.format('u[x + y + 2]', 'u[x + y + 3]', 'u[x + y + 4]')} END END
  WHEN 7 THEN CASE WHEN has_u THEN CASE WHEN y % 2 = 0 THEN {_P2.format('u[x + y // 2 + 2]', 'u[x + y // 2 + 3]')} ELSE {_P3.format('u[x + y // 2 + 2]', 'u[x + y // 2 + 3]', 'u[x + y // 2 + 4]')} END END
  WHEN 8 THEN CASE WHEN has_l THEN CASE WHEN x + 2 * y > 5 THEN l[5] WHEN x + 2 * y = 5 THEN (l[4] + 3 * l[5] + 2) >> 2 WHEN x % 2 = 0 THEN {_P2.format('l[y + x // 2 + 2]', 'l[y + x // 2 + 3]')} ELSE {_P3.format('l[y + x // 2 + 2]', 'l[y + x // 2 + 3]', 'l[y + x // 2 + 4]')} END END
  ELSE CASE WHEN has_u AND has_l THEN CASE
    WHEN mode = 4 THEN CASE WHEN x > y THEN {_P3.format('u[x - y]', 'u[x - y + 1]', 'u[x - y + 2]')} WHEN x < y THEN {_P3.format('l[y - x]', 'l[y - x + 1]', 'l[y - x + 2]')} ELSE {_P3.format('u[2]', 'u[1]', 'l[2]')} END
    WHEN mode = 5 THEN CASE WHEN 2 * x - y = -1 THEN {_P3.format('l[2]', 'l[1]', 'u[2]')} WHEN 2 * x < y THEN {_P3.format('l[y + 1]', 'l[y]', 'l[y - 1]')} WHEN y % 2 = 0 THEN {_P2.format('u[x - y // 2 + 1]', 'u[x - y // 2 + 2]')} ELSE {_P3.format('u[x - y // 2]', 'u[x - y // 2 + 1]', 'u[x - y // 2 + 2]')} END
    ELSE CASE WHEN 2 * y - x = -1 THEN {_P3.format('l[2]', 'l[1]', 'u[2]')} WHEN 2 * y < x THEN {_P3.format('u[x + 1]', 'u[x]', 'u[x - 1]')} WHEN x % 2 = 0 THEN {_P2.format('l[y - x // 2 + 1]', 'l[y - x // 2 + 2]')} ELSE {_P3.format('l[y - x // 2]', 'l[y - x // 2 + 1]', 'l[y - x // 2 + 2]')} END END END END AS s FROM p)
SELECT object_id, k, mode::INT AS mode, CASE WHEN count(s) = 16 THEN string_agg(s::VARCHAR, ',' ORDER BY i) END AS block FROM v GROUP BY n, object_id, k, mode"""
