"""Raster queries: index maps, colour, packing, and the relational parts of still-image formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions import raster
from reelspark.operators import images
from reelspark.sources.views import PIXELS_SQL, pixels, sql, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def nearest_resample(spark, d):
    """Every image stretched to 13 x 5: its packed samples are one array, which target pixels index by their source's place."""
    src = pixels(spark, d, by_image=True).select("img", "x", "y", raster.rgb565(C("r"), C("g"), C("b")).alias("v"))
    whole = src.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    grid = whole.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = raster.nearest(C("dy"), C("h"), F.lit(5)) * C("w") + raster.nearest(C("dx"), C("w"), F.lit(13))
    return grid.select("img", "dx", "dy", F.get("s", at.cast("int"))["v"].alias("v"))


QUERIES["nearest_resample"] = nearest_resample
ORACLE_SQL["nearest_resample"] = f"""WITH {PIXELS_SQL}, size AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1),
grid AS (SELECT img, dx::INT AS dx, dy::INT AS dy, (2 * dx + 1) * w // 26 AS x, (2 * dy + 1) * h // 10 AS y FROM size, generate_series(0, 12) a(dx), generate_series(0, 4) b(dy))
SELECT g.img, dx, dy, (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS v FROM grid g JOIN pixels p ON g.img = p.img AND g.x = p.x AND g.y = p.y"""


def colour(spark, d, convert):
    r, g, b = convert(C("r"), C("g"), C("b"))
    return pixels(spark, d).select("img", "x", "y", raster.rgb565(r, g, b).alias("v"))


_CLAMP = "greatest(least({}, 255), 0)"
_PACK = "(" + _CLAMP + " >> 3) * 2048 + (" + _CLAMP + " >> 2) * 32 + (" + _CLAMP + " >> 3)"
QUERIES["rgb565_pack"] = lambda spark, d: colour(spark, d, lambda r, g, b: (r, g, b))
ORACLE_SQL["rgb565_pack"] = f"WITH {PIXELS_SQL} SELECT img, x, y, (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS v FROM pixels"
QUERIES["yuv_to_rgb565"] = lambda spark, d: colour(spark, d, raster.yuv_to_rgb)
ORACLE_SQL["yuv_to_rgb565"] = f"WITH {PIXELS_SQL}, c AS (SELECT *, 298 * (r - 16) AS c, g - 128 AS d, b - 128 AS e FROM pixels) SELECT img, x, y, " + _PACK.format("((c + 409 * e + 128) >> 8)", "((c - 100 * d - 208 * e + 128) >> 8)", "((c + 516 * d + 128) >> 8)") + " AS v FROM c"
QUERIES["ycbcr_to_rgb565"] = lambda spark, d: colour(spark, d, raster.ycbcr_to_rgb)
ORACLE_SQL["ycbcr_to_rgb565"] = f"WITH {PIXELS_SQL}, c AS (SELECT *, g - 128 AS cb, b - 128 AS cr FROM pixels) SELECT img, x, y, " + _PACK.format("(r + ((359 * cr) >> 8))", "(r - ((88 * cb + 183 * cr) >> 8))", "(r + ((454 * cb) >> 8))") + " AS v FROM c"


def detile(spark, d):
    """Where each byte, and each 10-bit sample, of a 300-byte-wide surface lies in 128-byte columns; and the sample."""
    x = view(spark, d, "octets").select("object_id", "k", (C("w") % 300).alias("x"), (C("b0") % 64).alias("y"), C("w") * 16384 + C("b2") * 64 + C("b1"))
    x = x.toDF("object_id", "k", "x", "y", "word")
    return x.select("object_id", "k", raster.detile_offset(C("x"), C("y"), F.lit(128 * 64)).alias("off8"), raster.detile_offset(F.floor(C("x") / 3) * 4, C("y"), F.lit(128 * 64)).alias("off10"), raster.unpack10(C("word"), C("x") % 3).alias("sample"))


QUERIES["detile"] = detile
ORACLE_SQL["detile"] = f"""WITH {sql('octets')}, t AS (SELECT object_id, k, w % 300 AS x, b0 % 64 AS y, w * 16384 + b2 * 64 + b1 AS word FROM octets)
SELECT object_id, k, x // 128 * 8192 + y * 128 + x % 128 AS off8, x // 3 * 4 // 128 * 8192 + y * 128 + x // 3 * 4 % 128 AS off10, ((word >> (10 * (x % 3))::INT) & 1023) * 64 AS sample FROM t"""


def png_unfilter(spark, d):
    """Sub and Up filters undone: running sums of the residuals along the line, or down the column, modulo 256."""
    p = pixels(spark, d, by_image=True)
    along = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("img", "x", "y", (F.sum("r").over(along) % 256).alias("sub"), (F.sum("r").over(down) % 256).alias("up"))


QUERIES["png_unfilter"] = png_unfilter
ORACLE_SQL["png_unfilter"] = f"WITH {PIXELS_SQL} SELECT img, x, y, (sum(r) OVER (PARTITION BY img, y ORDER BY x) % 256)::BIGINT AS sub, (sum(r) OVER (PARTITION BY img, x ORDER BY y) % 256)::BIGINT AS up FROM pixels"


def png_paeth(spark, d):
    """The predictor of every pixel from its left, upper and upper-left neighbours; outside is 0. And the residual by it."""
    p = pixels(spark, d, by_image=True)
    line, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    q = p.withColumn("a", F.lag("r", 1, 0).over(line)).withColumn("b", F.lag("r", 1, 0).over(column)).withColumn("c", F.lag("a", 1, 0).over(column))
    return q.select("img", "x", "y", raster.paeth(C("a"), C("b"), C("c")).alias("predicted"), F.pmod(C("r") - raster.paeth(C("a"), C("b"), C("c")), F.lit(256)).alias("residual"))


QUERIES["png_paeth"] = png_paeth
ORACLE_SQL["png_paeth"] = f"""WITH {PIXELS_SQL}, q AS (SELECT *, lag(r, 1, 0) OVER (PARTITION BY img, y ORDER BY x) AS a, lag(r, 1, 0) OVER (PARTITION BY img, x ORDER BY y) AS b2 FROM pixels),
s AS (SELECT *, lag(a, 1, 0) OVER (PARTITION BY img, x ORDER BY y) AS c FROM q),
t AS (SELECT *, CASE WHEN abs(b2 - c) <= abs(a - c) AND abs(b2 - c) <= abs(a + b2 - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b2 - 2 * c) THEN b2 ELSE c END AS predicted FROM s)
SELECT img, x, y, predicted, ((r - predicted) % 256 + 256) % 256 AS residual FROM t"""


def png_unfilter_lines(spark, d):
    """Lines filtered in the five ways, by number of image and line, and brought back."""
    p = pixels(spark, d, by_image=True)
    line, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    q = p.withColumn("a", F.lag("r", 1, 0).over(line)).withColumn("b0", F.lag("r", 1, 0).over(column)).withColumn("c", F.lag("a", 1, 0).over(column))
    kind = ((C("img") + C("y")) % 5).cast("int")
    guess = F.when(kind == 1, C("a")).when(kind == 2, C("b0")).when(kind == 3, F.floor((C("a") + C("b0")) / 2)).when(kind == 4, raster.paeth(C("a"), C("b0"), C("c"))).otherwise(0)
    coded = q.select("img", "y", kind.alias("filter"), "x", F.pmod(C("r") - guess, F.lit(256)).cast("int").alias("v"))
    lines = coded.groupBy("img", "y", "filter").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("samples"))
    back = images.unfilter(lines, 1)
    return back.select("img", "y", F.array_join("samples", ",").alias("line"))


QUERIES["png_unfilter_lines"] = png_unfilter_lines
ORACLE_SQL["png_unfilter_lines"] = f"WITH {PIXELS_SQL} SELECT img, y, string_agg(r::VARCHAR, ',' ORDER BY x) AS line FROM pixels GROUP BY 1, 2"


def png_palette(spark, d):
    """Sub-byte samples: scaled to 8 bits by depth, and as indexes into the image's palette (its first line's colours)."""
    p = pixels(spark, d)
    palette = p.where("y = 0").select(C("img").alias("p_img"), C("x").alias("entry"), C("r").alias("p_r"), C("g").alias("p_g"), C("b").alias("p_b"))
    depth = F.get(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]), (C("img") % 4).cast("int"))
    low = C("r") % F.pow(F.lit(2), depth).cast("int")
    indexed = p.select("img", "x", "y", depth.alias("depth"), low.alias("sample"), (C("r") % 9).alias("entry"))
    joined = indexed.join(palette, (C("img") == C("p_img")) & (indexed["entry"] == palette["entry"]), "left")
    return joined.select("img", "x", "y", raster.expand_bits(C("sample"), C("depth")).alias("grey"), F.coalesce(raster.rgb565(C("p_r"), C("p_g"), C("p_b")), F.lit(0)).alias("v"))


QUERIES["png_palette"] = png_palette
ORACLE_SQL["png_palette"] = f"""WITH {PIXELS_SQL}, i AS (SELECT *, ([1, 2, 4, 8])[img % 4 + 1] AS depth, r % 9 AS entry FROM pixels)
SELECT i.img, i.x, i.y, (CASE depth WHEN 1 THEN i.r % 2 * 255 WHEN 2 THEN i.r % 4 * 85 WHEN 4 THEN i.r % 16 * 17 ELSE i.r END)::INT AS grey, coalesce((p.r >> 3) * 2048 + (p.g >> 2) * 32 + (p.b >> 3), 0) AS v
FROM i LEFT JOIN pixels p ON p.img = i.img AND p.y = 0 AND p.x = i.entry"""


def gif_compose(spark, d):
    """Frames drawn over one canvas: the last opaque pixel of each place, with frames' lines put in order first.

    Images of a group of ten are the frames of one picture; colour index r % 4 = 0 is transparent, the ground is 0.
    """
    p = pixels(spark, d).withColumn("line", raster.interlace_row(C("y"), F.lit(8)))
    last = F.max(F.when(C("r") % 4 != 0, F.struct("img", raster.rgb565(C("r"), C("g"), C("b")).alias("v"))))
    return p.groupBy(F.floor(C("img") / 10).alias("picture"), "x", "line").agg(F.coalesce(last["v"], F.lit(0)).alias("v"), F.count("*").alias("frames"))


QUERIES["gif_compose"] = gif_compose
ORACLE_SQL["gif_compose"] = f"""WITH {PIXELS_SQL}, l AS (SELECT *, ([0, 4, 2, 6, 1, 3, 5, 7])[y + 1] AS line FROM pixels)
SELECT img // 10 AS picture, x, line, coalesce(arg_max((r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3), img) FILTER (WHERE r % 4 <> 0), 0) AS v, count(*) AS frames FROM l GROUP BY 1, 2, 3"""


def jpeg_upsample(spark, d):
    """4:2:0 chroma brought to full size: each pixel joins the chroma sample of its 2 x 2 block."""
    p = pixels(spark, d, by_image=True)
    # One row of each block carries its chroma: a window over the block, no join of the image with itself.
    block = Window.partitionBy("img", F.floor(C("x") / 2), F.floor(C("y") / 2)).orderBy("y", "x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = p.select("*", F.first("g").over(block).alias("cb"), F.first("b").over(block).alias("cr"))
    r, g, b = raster.ycbcr_to_rgb(C("r"), C("cb"), C("cr"))
    return full.select("img", "x", "y", r.alias("red"), g.alias("green"), b.alias("blue"))


QUERIES["jpeg_upsample"] = jpeg_upsample
ORACLE_SQL["jpeg_upsample"] = f"""WITH {PIXELS_SQL}, c AS (SELECT p.img, p.x, p.y, p.r, q.g - 128 AS cb, q.b - 128 AS cr FROM pixels p JOIN pixels q ON p.img = q.img AND q.x = p.x // 2 * 2 AND q.y = p.y // 2 * 2)
SELECT img, x, y, {_CLAMP.format('r + ((359 * cr) >> 8)')} AS red, {_CLAMP.format('r - ((88 * cb + 183 * cr) >> 8)')} AS green, {_CLAMP.format('r + ((454 * cb) >> 8)')} AS blue FROM c"""


def duplicate_images(spark, d):
    """Equal rasters by a hash of their packed pixels: one row for each different raster."""
    packed = pixels(spark, d).select((C("img") % 40).alias("frame"), "img", "x", "y", (C("r") % 2).alias("bit"))
    raster_bits = packed.groupBy("img").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "bit"))), lambda p: p["bit"].cast("string")), "").alias("bits"))
    return raster_bits.groupBy(F.md5("bits").alias("raster")).agg(F.count("*").alias("copies"), F.min("img").alias("first_img"))


QUERIES["duplicate_images"] = duplicate_images
ORACLE_SQL["duplicate_images"] = f"WITH {PIXELS_SQL}, b AS (SELECT img, string_agg((r % 2)::VARCHAR, '' ORDER BY y, x) AS bits FROM pixels GROUP BY 1) SELECT md5(bits) AS raster, count(*) AS copies, min(img) AS first_img FROM b GROUP BY 1"


def i420_to_rgb565(spark, d):
    """4:2:0 buffers of the images, stretched to 13 x 5: each target pixel looks its three samples up in the planes and is packed."""
    byte = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")
    joined = lambda rows: F.array_join(F.transform(F.sort_array(rows), lambda p: p["v"]), "")
    even = (C("x") % 2 == 0) & (C("y") % 2 == 0)
    plane = lambda v, where=None: joined(F.collect_list(F.when(where, F.struct("y", "x", byte(C(v)).alias("v"))) if where is not None else F.struct("y", "x", byte(C(v)).alias("v"))))
    p = pixels(spark, d, by_image=True).groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.unhex(F.concat(plane("r"), plane("g", even), plane("b", even))).alias("content"))
    grid = p.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(4))))
    y, u, v = raster.i420(C("content"), C("w"), C("h"), raster.nearest(C("dx"), C("w"), F.lit(13)), raster.nearest(C("dy"), C("h"), F.lit(5)))
    r, g, b = raster.yuv_to_rgb(y, u, v)
    return grid.select("img", "dx", "dy", raster.rgb565(r, g, b).alias("v"))


QUERIES["i420_to_rgb565"] = i420_to_rgb565
ORACLE_SQL["i420_to_rgb565"] = f"""WITH {PIXELS_SQL}, size AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1),
grid AS (SELECT img, dx::INT AS dx, dy::INT AS dy, (2 * dx + 1) * w // 26 AS x, (2 * dy + 1) * h // 10 AS y FROM size, generate_series(0, 12) a(dx), generate_series(0, 4) b(dy)),
c AS (SELECT g.img, dx, dy, 298 * (p.r - 16) AS c, q.g - 128 AS d, q.b - 128 AS e FROM grid g JOIN pixels p ON p.img = g.img AND p.x = g.x AND p.y = g.y JOIN pixels q ON q.img = g.img AND q.x = g.x // 2 * 2 AND q.y = g.y // 2 * 2)
SELECT img, dx, dy, """ + _PACK.format("((c + 409 * e + 128) >> 8)", "((c - 100 * d - 208 * e + 128) >> 8)", "((c + 516 * d + 128) >> 8)") + " AS v FROM c"
