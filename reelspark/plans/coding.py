"""Queries of coding tools: bit strings, canonical codes, transforms, prediction, overlap and concealment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions import coding
from reelspark.sources.views import PIXELS_SQL, pixels, sql, table, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def slice_header(spark, d):
    """First macroblock, slice type and parameter-set id of slice headers; and the last as a signed number."""
    x = view(spark, d, "octets").select("object_id", "k", F.concat(coding.bits(C("b0"), 8), coding.bits(C("b1"), 8), coding.bits(C("b2"), 8), coding.bits(C("w"), 16)).alias("s"))
    x = x.withColumn("a", coding.ue(C("s"), 1)).withColumn("b", coding.ue(C("s"), C("a.next"))).withColumn("c", coding.ue(C("s"), C("b.next")))
    return x.select("object_id", "k", C("a.value").alias("first_mb"), C("b.value").alias("slice_type"), C("c.value").alias("set_id"), coding.se(C("c.value")).alias("signed_id"))


QUERIES["slice_header"] = slice_header
ORACLE_SQL["slice_header"] = f"""WITH {sql('octets')}, s0 AS (SELECT object_id, k, lpad(bin(b0), 8, '0') || lpad(bin(b1), 8, '0') || lpad(bin(b2), 8, '0') || lpad(bin(w), 16, '0') AS s FROM octets),
s1 AS (SELECT *, strpos(s, '1') - 1 AS z FROM s0), s2 AS (SELECT *, CASE WHEN z >= 0 THEN s[z + 1:2 * z + 1] END AS x1, substr(s, 2 * z + 2) AS t FROM s1),
s3 AS (SELECT *, strpos(t, '1') - 1 AS z2 FROM s2), s4 AS (SELECT *, substr(t, z2 + 1, z2 + 1) AS x2, substr(t, 2 * z2 + 2) AS u FROM s3), s5 AS (SELECT *, strpos(u, '1') - 1 AS z3 FROM s4),
n AS (SELECT *, CASE WHEN z >= 0 AND length(x1) = z + 1 THEN z END AS ok1, CASE WHEN z >= 0 AND length(x1) = z + 1 AND z2 >= 0 AND length(x2) = z2 + 1 THEN z2 END AS ok2 FROM s5),
v AS (SELECT object_id, k,
  CASE WHEN ok1 IS NOT NULL THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(x1, ''), lambda c: c::BIGINT)), lambda a, c: a * 2 + c) - 1 END AS first_mb,
  CASE WHEN ok2 IS NOT NULL THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(x2, ''), lambda c: c::BIGINT)), lambda a, c: a * 2 + c) - 1 END AS slice_type,
  CASE WHEN ok2 IS NOT NULL AND z3 >= 0 AND length(substr(u, z3 + 1, z3 + 1)) = z3 + 1 THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(u, z3 + 1, z3 + 1), ''), lambda c: c::BIGINT)), lambda a, c: a * 2 + c) - 1 END AS set_id FROM n)
SELECT *, CASE WHEN set_id % 2 = 1 THEN (set_id + 1) // 2 ELSE -(set_id // 2) END AS signed_id FROM v"""


def canonical_codes(spark, d):
    """Canonical prefix codes from code lengths: a code is the running Kraft sum of the shorter and earlier ones, cut to its length.

    Symbols are the parts of a brand, their lengths 10 to 15 bits by size; null codes are those beyond a full table.
    """
    x = table(spark, d, "part").select(C("p_brand").alias("book"), C("p_partkey").alias("symbol"), (C("p_size") % 6 + 10).alias("bits"))
    before = Window.partitionBy("book").orderBy("bits", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.pow(F.lit(2), 15 - C("bits")).cast("bigint")).over(before), F.lit(0))
    step = F.pow(F.lit(2), 15 - C("bits"))
    return x.withColumn("used", used).select("book", "symbol", "bits", F.when(C("used") + step <= 32768, F.floor(C("used") / step)).alias("code"))


QUERIES["canonical_codes"] = canonical_codes
ORACLE_SQL["canonical_codes"] = """WITH x AS (SELECT p_brand AS book, p_partkey AS symbol, p_size % 6 + 10 AS bits FROM part),
u AS (SELECT *, coalesce(sum(1 << (15 - bits)) OVER (PARTITION BY book ORDER BY bits, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM x)
SELECT book, symbol, bits, CASE WHEN used + (1 << (15 - bits)) <= 32768 THEN used // (1 << (15 - bits)) END AS code FROM u"""


def inverse_cosine(spark, d):
    """Both passes of the 8 x 8 inverse cosine transform as joins with the basis and sums: coefficients are the images' levels."""
    basis = spark.createDataFrame([(k, n, coding.cosine(k, n)) for k in range(8) for n in range(8)], "k int, n int, v bigint")
    p = pixels(spark, d, by_image=True).select("img", "x", "y", (C("r") - 128).cast("bigint").alias("c"))
    rows = p.join(F.broadcast(basis), C("x") == C("k")).groupBy("img", "y", "n").agg(F.shiftright(F.sum(C("c") * C("v")) + 4096, 13).alias("c"))
    out = rows.toDF("img", "y", "col", "c").join(F.broadcast(basis), C("y") == C("k")).groupBy("img", "col", "n").agg(F.shiftright(F.sum(C("c") * C("v")) + 4096, 13).alias("v"))
    return out.select("img", C("col").alias("x"), C("n").alias("y"), F.greatest(F.least(C("v") + 128, F.lit(255)), F.lit(0)).alias("v"))


QUERIES["inverse_cosine"] = inverse_cosine
ORACLE_SQL["inverse_cosine"] = f"""WITH {PIXELS_SQL}, basis(k, n, v) AS (VALUES {', '.join(f'({k}, {n}, {coding.cosine(k, n)})' for k in range(8) for n in range(8))}),
a AS (SELECT img, y, n AS col, (sum((r - 128) * v) + 4096)::BIGINT >> 13 AS c FROM pixels JOIN basis ON x = k GROUP BY 1, 2, 3),
b AS (SELECT img, col, n, (sum(c * v) + 4096)::BIGINT >> 13 AS v FROM a JOIN basis ON y = k GROUP BY 1, 2, 3)
SELECT img, col AS x, n AS y, greatest(least(v + 128, 255), 0) AS v FROM b"""


def half_samples(spark, d):
    """Half-sample interpolation along lines: six neighbours by a window, edges repeated."""
    p = pixels(spark, d, by_image=True)
    w = Window.partitionBy("img", "y").orderBy("x")
    edge = lambda k: F.coalesce(F.lag("r", -k).over(w) if k < 0 else F.lead("r", k).over(w), F.first("r").over(whole) if k < 0 else F.last("r").over(whole))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return p.select("img", "x", "y", coding.six_tap(edge(-2), edge(-1), C("r"), edge(1), edge(2), edge(3)).alias("half"))


QUERIES["half_samples"] = half_samples
_L = "coalesce(lag(r, {0}) OVER w, first_value(r) OVER w)"
_R = "coalesce(lead(r, {0}) OVER w, last_value(r) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
ORACLE_SQL["half_samples"] = f"WITH {PIXELS_SQL} SELECT img, x, y, greatest(least(({_L.format(2)} - 5 * {_L.format(1)} + 20 * r + 20 * {_R.format(1)} - 5 * {_R.format(2)} + {_R.format(3)} + 16) >> 5, 255), 0) AS half FROM pixels WINDOW w AS (PARTITION BY img, y ORDER BY x)"


def motion_prediction(spark, d):
    """Median of the left, upper and upper-right vectors (0 outside), and intra DC from the left and upper samples (128 without either)."""
    p = pixels(spark, d, by_image=True)
    line, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    q = p.withColumn("a", F.lag("r").over(line)).withColumn("b", F.lag("r").over(column)).withColumn("up_right", F.lead("r").over(line)).withColumn("c", F.lag("up_right").over(column))
    zero = lambda n: F.coalesce(C(n), F.lit(0))
    dc = F.when(C("a").isNotNull() & C("b").isNotNull(), F.shiftright(C("a") + C("b") + 1, 1)).otherwise(F.coalesce("a", "b", F.lit(128)))
    return q.select("img", "x", "y", coding.median3(zero("a"), zero("b"), zero("c")).alias("median"), dc.alias("dc"))


QUERIES["motion_prediction"] = motion_prediction
ORACLE_SQL["motion_prediction"] = f"""WITH {PIXELS_SQL}, q AS (SELECT img, x, y, lag(r) OVER (PARTITION BY img, y ORDER BY x) AS a, lag(r) OVER (PARTITION BY img, x ORDER BY y) AS b2, lead(r) OVER (PARTITION BY img, y ORDER BY x) AS u FROM pixels),
s AS (SELECT *, coalesce(a, 0) AS l, coalesce(b2, 0) AS m, coalesce(lag(u) OVER (PARTITION BY img, x ORDER BY y), 0) AS n FROM q)
SELECT img, x, y, l + m + n - greatest(l, m, n) - least(l, m, n) AS median, CASE WHEN a IS NOT NULL AND b2 IS NOT NULL THEN (a + b2 + 1) >> 1 ELSE coalesce(a, b2, 128) END AS dc FROM s"""


def conceal(spark, d):
    """Lost samples (every one with b % 5 = 0) taken from the image before in their sequence at their place; null where there is none.

    Sequences are of sixteen images: each place of each sequence is a window of its own.
    """
    p = pixels(spark, d).withColumn("sequence", F.floor(C("img") / 16))
    order = Window.partitionBy("sequence", "x", "y").orderBy("img").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(C("b") % 5 != 0, C("r")), ignorenulls=True).over(order)
    return p.withColumn("shown", seen).groupBy("img").agg(F.count(F.when(C("b") % 5 == 0, 1)).alias("concealed"), F.sum("shown").alias("level"))


QUERIES["conceal"] = conceal
ORACLE_SQL["conceal"] = f"""WITH {PIXELS_SQL}, s AS (SELECT *, last_value(CASE WHEN b % 5 <> 0 THEN r END IGNORE NULLS) OVER (PARTITION BY img // 16, x, y ORDER BY img ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM pixels)
SELECT img, count(*) FILTER (WHERE b % 5 = 0) AS concealed, sum(shown)::BIGINT AS level FROM s GROUP BY 1"""


def overlap_add(spark, d):
    """Blocks of 320 samples that overlap by half under a rising and a falling ramp: each sample meets the one of the block before."""
    x = view(spark, d, "pcm").select("stream_id", F.floor(C("n") / 320).alias("block"), (C("n") % 320).alias("i"), "l")
    rise = x.where("i < 160").select("stream_id", "block", "i", (C("l") * C("i")).alias("up"))
    fall = x.where("i >= 160").select("stream_id", (C("block") + 1).alias("block"), (C("i") - 160).alias("i"), (C("l") * (320 - C("i"))).alias("down"))
    both = rise.join(fall, ["stream_id", "block", "i"], "left")
    return both.select("stream_id", "block", "i", coding.saturate16(F.floor((C("up") + F.coalesce("down", F.lit(0))) / 160)).alias("v"))


QUERIES["overlap_add"] = overlap_add
ORACLE_SQL["overlap_add"] = f"""WITH {sql('pcm')}, x AS (SELECT stream_id, n // 320 AS block, n % 320 AS i, l FROM pcm)
SELECT a.stream_id, a.block, a.i, greatest(least(floor((a.l * a.i + coalesce(b.l * (320 - b.i), 0)) / 160)::BIGINT, 32767), -32768) AS v FROM x a LEFT JOIN x b ON a.stream_id = b.stream_id AND b.block = a.block - 1 AND b.i = a.i + 160 WHERE a.i < 160"""


def stereo_tools(spark, d):
    """Mid and side to left and right with saturation, and a rounding shift with halves away from zero."""
    x = view(spark, d, "pcm")
    return x.select("stream_id", "n", coding.saturate16(C("l") + C("r")).alias("left"), coding.saturate16(C("l") - C("r")).alias("right"), coding.round_shift(C("l") * 3, 4).alias("rounded"))


QUERIES["stereo_tools"] = stereo_tools
ORACLE_SQL["stereo_tools"] = f"WITH {sql('pcm')} SELECT stream_id, n, greatest(least(l + r, 32767), -32768) AS \"left\", greatest(least(l - r, 32767), -32768) AS \"right\", CASE WHEN l < 0 THEN -((-l * 3 + 8) >> 4) ELSE (l * 3 + 8) >> 4 END AS rounded FROM pcm"


def slice_groups(spark, d):
    x = pixels(spark, d).select((C("img") % 3).alias("kind"), "x", "y").distinct()
    return x.select("kind", "x", "y", coding.slice_group(C("kind"), C("x"), C("y"), F.lit(8), F.lit(3)).alias("slice_group"))


QUERIES["slice_groups"] = slice_groups
ORACLE_SQL["slice_groups"] = f"""WITH {PIXELS_SQL}, m AS (SELECT DISTINCT img % 3 AS kind, x, y, y * 8 + x AS i FROM pixels)
SELECT kind, x, y, (CASE kind WHEN 0 THEN i // 3 % 3 WHEN 1 THEN (i % 8 + i // 8 * 3 // 2) % 3 ELSE CASE WHEN i < 32 THEN 0 ELSE 1 END END)::INT AS slice_group FROM m"""


def weights(spark, d):
    """Prediction weights from denominators and deltas, and the offset of chroma for its weight; none beyond a denominator of 7."""
    x = view(spark, d, "octets").select("object_id", "k", (C("b0") % 10).alias("denom"), (C("b1") - 128).alias("delta"), (C("w") % 1024 - 512).alias("raw"))
    weight = F.pow(F.lit(2), C("denom")).cast("bigint") + C("delta")
    clip = lambda v: F.greatest(F.least(v, F.lit(127)), F.lit(-128))
    offset = clip(C("raw") + 128 - F.floor(128 * weight / F.pow(F.lit(2), C("denom"))))
    return x.where("denom <= 7").select("object_id", "k", "denom", weight.alias("weight"), offset.alias("chroma_offset"))


QUERIES["prediction_weights"] = weights
ORACLE_SQL["prediction_weights"] = f"""WITH {sql('octets')}, x AS (SELECT object_id, k, b0 % 10 AS denom, (1 << (b0 % 10)::INT) + b1 - 128 AS weight, w % 1024 - 512 AS raw FROM octets WHERE b0 % 10 <= 7)
SELECT object_id, k, denom, weight, greatest(least(raw + 128 - ((128 * weight) >> denom::INT), 127), -128) AS chroma_offset FROM x"""


def configuration_records(spark, d):
    """Decoder configuration heads (version, profile, level, NAL length size), and addresses in units of 64 where aligned."""
    x = view(spark, d, "octets")
    return x.select(
        "object_id", "k", C("b1").alias("profile"), C("b2").alias("level"), (C("w") % 4 + 1).alias("nal_length"),
        F.when(C("w") % 64 == 0, F.floor(C("w") / 64)).alias("address"), F.floor((C("w") + 63) / 64).alias("stride"),
    )


QUERIES["configuration_records"] = configuration_records
ORACLE_SQL["configuration_records"] = f"WITH {sql('octets')} SELECT object_id, k, b1 AS profile, b2 AS level, w % 4 + 1 AS nal_length, CASE WHEN w % 64 = 0 THEN w // 64 END AS address, (w + 63) // 64 AS stride FROM octets"


def frame_gaps(spark, d):
    """Missing frames: how many numbers (modulo 16) lie between a picture and the one before in its stream."""
    x = view(spark, d, "slices")
    before = F.lag("lsb").over(Window.partitionBy("stream_id").orderBy("n"))
    return x.select("stream_id", "n", "lsb", F.when(C("idr") | before.isNull() | (before == C("lsb")), 0).otherwise(F.pmod(C("lsb") - before - 1, F.lit(16))).alias("missing"))


QUERIES["frame_gaps"] = frame_gaps
ORACLE_SQL["frame_gaps"] = f"""WITH {sql('slices')}, b AS (SELECT *, lag(lsb) OVER (PARTITION BY stream_id ORDER BY n) AS prev FROM slices)
SELECT stream_id, n, lsb, CASE WHEN idr OR prev IS NULL OR prev = lsb THEN 0 ELSE ((lsb - prev - 1) % 16 + 16) % 16 END AS missing FROM b"""
