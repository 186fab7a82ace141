"""Queries of intra prediction: whole macroblocks and chroma, and pictures rebuilt block by block."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reelspark.functions import intra
from reelspark.operators import prediction
from reelspark.plans.recovery import ORACLE_SQL as _BLOCKS
from reelspark.sources.views import PIXELS_SQL, table

QUERIES, ORACLE_SQL = {}, {}
C = F.col

# Samples of the sides, in an SQL that both engines read.
_UP = lambda k: f"(p_partkey * {k + 3} + p_size * {k * k + 1}) % 256"
_LEFT = lambda k: f"(p_partkey * {k + 5} + p_size * {7 * k + 2}) % 256"
_CORNER = "(p_partkey * 11 + p_size) % 256"


def intra_macroblocks(spark, d):
    """Predictions of 16 x 16 luma (even parts) and 8 x 8 chroma blocks (odd parts) by each of the four modes, with sides missing here and there."""
    x = table(spark, d, "part").selectExpr("p_partkey AS id", "p_size % 4 AS mode", *(
        f"CASE WHEN {there} THEN transform(array({', '.join(f(k) for k in range(16))}), v -> int(v)) END AS {name}" for name, there, f in (("above", "p_partkey % 7 > 0", _UP), ("left", "p_partkey % 5 > 0", _LEFT))
    ), f"CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 > 0 THEN int({_CORNER}) END AS corner")
    small = lambda c: F.slice(c, 1, 8)
    block = F.when(C("id") % 2 == 0, intra.predicted_16(C("mode"), C("above"), C("left"), C("corner"))).otherwise(intra.predicted_chroma(C("mode"), small("above"), small("left"), C("corner")))
    return x.select("id", "mode", F.array_join(F.transform(block, lambda v: v.cast("string")), ",").alias("block"))


QUERIES["intra_macroblocks"] = intra_macroblocks
_SUM = lambda side, a, b: f"list_sum({side}[{a}:{b}])::BIGINT"
_FOUR = lambda side, k: _SUM(side, 4 * k + 1, 4 * k + 4)
_BOTH = lambda k: f"coalesce(({_FOUR('u', k)} + {_FOUR('l', k)} + 4) >> 3, ({_FOUR('u', k)} + 2) >> 2, ({_FOUR('l', k)} + 2) >> 2, 128)"
# A side with the corner before it is w: the sample k is w[k + 2].
_TILT = lambda side: f"list_sum(list_transform(range(1, z // 2 + 1), lambda k: k * (([corner] || {side})[z // 2 + k + 1] - ([corner] || {side})[z // 2 - k + 1])))::BIGINT"
ORACLE_SQL["intra_macroblocks"] = f"""WITH s AS (SELECT p_partkey AS id, p_size % 4 AS mode, CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 8 END AS z, CASE WHEN p_partkey % 7 > 0 THEN [{', '.join(_UP(k) for k in range(16))}] END AS u,
  CASE WHEN p_partkey % 5 > 0 THEN [{', '.join(_LEFT(k) for k in range(16))}] END AS l, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 > 0 THEN {_CORNER} END AS corner FROM part),
t AS (SELECT *, (CASE z WHEN 16 THEN ['v', 'h', 'd', 'p'] ELSE ['d', 'h', 'v', 'p'] END)[mode + 1] AS m, {_TILT('u')} AS hh, {_TILT('l')} AS vv, CASE z WHEN 16 THEN 5 ELSE 34 END AS scale, z // 2 - 1 AS mid FROM s),
p AS (SELECT *, CASE WHEN z = 16 THEN [coalesce(({_SUM('u', 1, 16)} + {_SUM('l', 1, 16)} + 16) >> 5, ({_SUM('u', 1, 16)} + 8) >> 4, ({_SUM('l', 1, 16)} + 8) >> 4, 128)]
  ELSE [{_BOTH(0)}, coalesce(({_FOUR('u', 1)} + 2) >> 2, ({_FOUR('l', 0)} + 2) >> 2, 128), coalesce(({_FOUR('l', 1)} + 2) >> 2, ({_FOUR('u', 0)} + 2) >> 2, 128), {_BOTH(1)}] END AS means, (scale * hh + 32) >> 6 AS b, (scale * vv + 32) >> 6 AS c FROM t)
SELECT id, mode, array_to_string(CASE m WHEN 'v' THEN CASE WHEN u IS NOT NULL THEN list_transform(range(z * z), lambda i: u[i % z + 1]) END WHEN 'h' THEN CASE WHEN l IS NOT NULL THEN list_transform(range(z * z), lambda i: l[i // z + 1]) END
  WHEN 'd' THEN list_transform(range(z * z), lambda i: means[CASE WHEN z = 16 THEN 1 ELSE i // 32 * 2 + i % 8 // 4 + 1 END])
  ELSE CASE WHEN corner IS NOT NULL THEN list_transform(range(z * z), lambda i: greatest(least((16 * (u[z] + l[z]) + 16 + b * (i % z - mid) + c * (i // z - mid)) >> 5, 255), 0)) END END, ',') AS block FROM p"""


def intra_pictures(spark, d):
    """Pictures of 4 x 4 images rebuilt from differences: blocks of 4 x 4 samples in decoding order, predicted from those rebuilt before; the mean along the upper and left edge, else all nine modes."""
    level = lambda e: F.floor(F.abs(e.cast("double")) * 1000).cast("int") % 256 % 41 - 20
    at = lambda q, i: F.get(C("e"), (F.floor(q / 2) * 32 + q % 2 * 4 + F.floor(i / 4) * 8 + i % 4).cast("int"))
    quarter = lambda q: F.struct(q.alias("q"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: at(q, i)).alias("residual"))
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", level).alias("e"))
    x = x.select(F.floor(C("vec_id") / 16).alias("picture"), (C("vec_id") % 16).cast("int").alias("t"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), quarter)).alias("p"))
    x = x.select("picture", (C("t") % 4 * 2 + C("p.q") % 2).cast("int").alias("across"), (F.floor(C("t") / 4) * 2 + F.floor(C("p.q") / 2)).cast("int").alias("down"), "p.residual")
    x = x.selectExpr("*", "bigint((down DIV 4 * 2 + across DIV 4) * 16 + down % 4 DIV 2 * 8 + across % 4 DIV 2 * 4 + down % 2 * 2 + across % 2) AS n", "CASE WHEN across = 0 OR down = 0 THEN 2 ELSE int((picture + 3 * across + 5 * down) % 9) END AS mode")
    return prediction.rebuilt(x).select("picture", "n", "across", "down", F.array_join(F.transform("block", lambda v: v.cast("string")), ",").alias("block"))


QUERIES["intra_pictures"] = intra_pictures
_CASE = _BLOCKS["intra_blocks"].split("mode, i, ", 1)[1].split(" AS s FROM p")[0]
_CASE = re.sub(r"\by\b", "(i // 4)", re.sub(r"\bx\b", "(i % 4)", _CASE))
ORACLE_SQL["intra_pictures"] = f"""WITH RECURSIVE {PIXELS_SQL},
b AS (SELECT picture, across, down, list(r % 41 - 20 ORDER BY i) AS residual FROM (
    SELECT img // 16 AS picture, img % 4 * 2 + x // 4 AS across, img % 16 // 4 * 2 + y // 4 AS down, y % 4 * 4 + x % 4 AS i, r FROM pixels) GROUP BY 1, 2, 3),
o AS (SELECT *, (down // 4 * 2 + across // 4) * 16 + down % 4 // 2 * 8 + across % 4 // 2 * 4 + down % 2 * 2 + across % 2 AS n, CASE WHEN across = 0 OR down = 0 THEN 2 ELSE (picture + 3 * across + 5 * down) % 9 END AS mode FROM b),
w AS (SELECT *, row_number() OVER (PARTITION BY picture ORDER BY n) AS j FROM o),
step(picture, n, j, across, down, img, block) AS (
  SELECT DISTINCT picture, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, list_transform(range(1024), lambda q: NULL::BIGINT), NULL::BIGINT[] FROM w
  UNION ALL
  SELECT picture, n, j, across, down, list_transform(range(1024), lambda q: CASE WHEN q % 32 // 4 = across AND q // 128 = down THEN block[q // 32 % 4 * 4 + q % 4 + 1] ELSE img[q + 1] END), block
  FROM (SELECT *, CASE WHEN len(list_filter(plain, lambda v: v IS NULL)) = 0 THEN list_transform(range(1, 17), lambda i: greatest(least(plain[i] + residual[i], 255), 0)::BIGINT) END AS block
    FROM (SELECT *, list_transform(range(16), lambda i: ({_CASE})::BIGINT) AS plain
      FROM (SELECT *, u0[2] IS NOT NULL AS has_u, l[2] IS NOT NULL AS has_l, CASE WHEN u0[6] IS NULL THEN u0[1:5] || [u0[5], u0[5], u0[5], u0[5]] ELSE u0 END AS u
        FROM (SELECT w.picture, w.n, w.j, w.across, w.down, w.mode, w.residual, p.img,
            list_transform(range(-1, 8), lambda k: CASE WHEN w.down > 0 AND w.across * 4 + k BETWEEN 0 AND 31 THEN p.img[(w.down * 4 - 1) * 32 + w.across * 4 + k + 1] END) AS u0,
            list_transform(range(-1, 4), lambda k: CASE WHEN w.across > 0 AND w.down * 4 + k >= 0 THEN p.img[(w.down * 4 + k) * 32 + w.across * 4] END) AS l
          FROM step p JOIN w ON w.picture = p.picture AND w.j = p.j + 1)))))
SELECT picture, n, across::INT AS across, down::INT AS down, array_to_string(block, ',') AS block FROM step WHERE j > 0"""
