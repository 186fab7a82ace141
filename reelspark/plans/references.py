"""Queries of picture order, reference marking, reference lists and picture slots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import references
from reelspark.sources.views import sql, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def _pictures(spark, d):
    x = view(spark, d, "slices")
    op = F.when(C("idr") | (C("n") % 6 != 0), 0).otherwise(F.floor(C("n") / 6) % 7)
    return x.select("stream_id", "n", "lsb", F.when(C("idr"), 0).otherwise(C("lsb")).alias("frame_num"), C("tid").alias("delta"), "is_reference", "idr", op.alias("op"), (C("n") % 3).alias("a"), (C("lsb") % 3).alias("b"), (op == 5).alias("resets"))


_PICTURES = f"""{sql('slices')}, o AS (SELECT *, CASE WHEN idr OR n % 6 <> 0 THEN 0 ELSE n // 6 % 7 END AS op FROM slices),
s AS (SELECT stream_id, n, lsb, CASE WHEN idr THEN 0 ELSE lsb END AS f, tid AS delta, is_reference, idr, op, n % 3 AS a, lsb % 3 AS b, op = 5 AS resets, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i FROM o)"""

QUERIES["h264_picture_order"] = lambda spark, d: references.h264_order(_pictures(spark, d), 4, 4, (2, 4, 1), -1).select("stream_id", "n", "poc0", "poc1", "poc2")
ORACLE_SQL["h264_picture_order"] = f"""WITH RECURSIVE {_PICTURES},
step(stream_id, n, i, p_lsb, p_msb, p_f, p_off, poc0, poc1, poc2) AS (
  SELECT stream_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM s WHERE i = 1
  UNION ALL
  SELECT stream_id, n, i, CASE WHEN resets THEN 0 WHEN is_reference THEN lsb ELSE q_lsb END, CASE WHEN resets THEN 0 WHEN is_reference THEN msb ELSE q_msb END,
    CASE WHEN resets THEN 0 ELSE f END, CASE WHEN resets THEN 0 ELSE off END,
    CASE WHEN resets THEN 0 ELSE msb + lsb END,
    CASE WHEN resets THEN 0 ELSE (CASE WHEN at > 0 THEN (at - 1) // 3 * 7 + ([2, 6, 7])[(at - 1) % 3 + 1] ELSE 0 END) - CASE WHEN is_reference THEN 0 ELSE 1 END + delta END,
    CASE WHEN resets OR idr THEN 0 ELSE 2 * (off + f) - CASE WHEN is_reference THEN 0 ELSE 1 END END
  FROM (SELECT *, CASE WHEN off + f > 0 THEN off + f - CASE WHEN is_reference THEN 0 ELSE 1 END ELSE 0 END AS at,
      CASE WHEN q_lsb - lsb >= 8 THEN q_msb + 16 WHEN lsb - q_lsb > 8 THEN q_msb - 16 ELSE q_msb END AS msb
    FROM (SELECT s.*, CASE WHEN s.idr THEN 0 ELSE p.p_lsb END AS q_lsb, CASE WHEN s.idr THEN 0 ELSE p.p_msb END AS q_msb, CASE WHEN s.idr THEN 0 WHEN p.p_f > s.f THEN p.p_off + 16 ELSE p.p_off END AS off
      FROM step p JOIN s ON s.stream_id = p.stream_id AND s.i = p.i + 1)))
SELECT stream_id, n, poc0, poc1, poc2 FROM step WHERE i > 0""".replace(" at ", " nth ").replace("(at ", "(nth ").replace("AS at,", "AS nth,")


def marked_references(spark, d):
    """Short-term and long-term references of each picture, and the list after it names the last of them and one that is not there."""
    m = references.mark_references(_pictures(spark, d), 4, 4).select("*", F.concat("short_term", "long_term").alias("first"))
    commands = F.array(F.element_at(F.concat(F.array(F.lit(-1).cast("bigint")), C("first")), -1), F.lit(-2).cast("bigint"))
    return m.select("stream_id", "n", F.array_join("short_term", ",").alias("short_term"), F.array_join("long_term", ",").alias("long_term"), F.array_join(references.reordered(C("first"), commands), ",").alias("list0"))


QUERIES["marked_references"] = marked_references
_DROP = "(CASE WHEN len(s1) + len(l1) >= 4 AND len(s1) > 0 THEN list_filter(s1, lambda x: x.n <> list_sort(list_transform(s1, lambda y: {{'w': CASE WHEN y.f > {c} THEN y.f - 16 ELSE y.f END, 'n': y.n}}))[1].n) ELSE s1 END)"
_W = "(CASE WHEN x.f > f THEN x.f - 16 ELSE x.f END)"
ORACLE_SQL["marked_references"] = f"""WITH RECURSIVE {_PICTURES},
step(stream_id, n, i, s, l, seen_s, seen_l) AS (
  SELECT stream_id, 0::BIGINT, 0::BIGINT, []::STRUCT(n BIGINT, f BIGINT)[], []::STRUCT(i BIGINT, n BIGINT)[], []::BIGINT[], []::BIGINT[] FROM s WHERE i = 1
  UNION ALL
  SELECT stream_id, n, i,
    CASE WHEN NOT is_reference THEN s0 WHEN op = 6 THEN {_DROP.format(c='g')} ELSE {_DROP.format(c='g')} || [{{'n': n, 'f': g}}] END,
    CASE WHEN NOT is_reference THEN l0 WHEN op = 6 THEN l1 || [{{'i': a, 'n': n}}] ELSE l1 END,
    list_transform(list_sort(list_transform(s0, lambda x: {{'w': -{_W}, 'n': x.n}})), lambda x: x.n), list_transform(list_sort(l0), lambda x: x.n)
  FROM (SELECT *, CASE WHEN op = 5 THEN 0 ELSE f END AS g,
      CASE WHEN op = 5 THEN [] WHEN op IN (1, 3) THEN list_filter(s0, lambda x: x.n IS DISTINCT FROM named) ELSE s0 END AS s1,
      CASE WHEN op = 5 THEN [] WHEN op = 2 OR op = 6 THEN list_filter(l0, lambda x: x.i <> a) WHEN op = 4 THEN list_filter(l0, lambda x: x.i < a)
        WHEN op = 3 AND named IS NOT NULL THEN list_filter(l0, lambda x: x.i <> b) || [{{'i': b, 'n': named}}] ELSE l0 END AS l1
    FROM (SELECT *, list_filter(s0, lambda x: {_W} = f - (a + 1))[1].n AS named FROM (SELECT s.*, CASE WHEN s.idr THEN [] ELSE p.s END AS s0, CASE WHEN s.idr THEN [] ELSE p.l END AS l0 FROM step p JOIN s ON s.stream_id = p.stream_id AND s.i = p.i + 1)))),
told AS (SELECT stream_id, n, seen_s, seen_l, seen_s || seen_l AS r FROM step WHERE i > 0)
SELECT stream_id, n, array_to_string(seen_s, ',') AS short_term, array_to_string(seen_l, ',') AS long_term, array_to_string(CASE WHEN len(r) > 1 THEN [r[-1]] || r[:-2] ELSE r END, ',') AS list0 FROM told"""


def picture_slots(spark, d):
    x = view(spark, d, "slices").withColumn("_run", F.sum(C("idr").cast("int")).over(Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    near = F.collect_list("n").over(Window.partitionBy("stream_id", "_run").orderBy("n").rowsBetween(-7, -1))
    x = x.select("stream_id", "n", C("n").alias("poc"), "idr", F.filter(near, lambda p: p % 3 != 1).alias("keep"))
    return references.picture_slots(x, 5)


QUERIES["picture_slots"] = picture_slots
ORACLE_SQL["picture_slots"] = f"""WITH RECURSIVE {sql('slices')}, r AS (SELECT *, sum(idr::INT) OVER (PARTITION BY stream_id ORDER BY n) AS run, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i FROM slices),
s AS (SELECT *, coalesce(list(n) FILTER (WHERE n % 3 <> 1) OVER (PARTITION BY stream_id, run ORDER BY n ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), []) AS keep FROM r),
step(stream_id, n, i, held, slot, occupancy) AS (
  SELECT stream_id, 0::BIGINT, 0::BIGINT, [NULL, NULL, NULL, NULL, NULL]::BIGINT[], NULL::INT, 0 FROM s WHERE i = 1
  UNION ALL
  SELECT stream_id, n, i, list_transform(now, lambda x, k: CASE WHEN k = free THEN n ELSE x END), (free - 1)::INT, (5 - len(list_filter(now, lambda x: x IS NULL)) + CASE WHEN free > 0 THEN 1 ELSE 0 END)::INT
  FROM (SELECT *, nullif(list_position(list_transform(now, lambda x: x IS NULL), true), 0) AS free FROM (
    SELECT s.stream_id, s.n, s.i, list_transform(p.held, lambda x: CASE WHEN list_contains(s.keep, x) THEN x END) AS now FROM step p JOIN s ON s.stream_id = p.stream_id AND s.i = p.i + 1)))
SELECT stream_id, n, slot, occupancy FROM step WHERE i > 0"""


#: Pictures of the display buffer.
DISPLAY = 3


def bounded_output(spark, d):
    """Display times with a buffer of three pictures; the pocs are a shuffle of each run's order."""
    x = view(spark, d, "slices").select("stream_id", "n", (C("lsb") * 5 % 16 + C("tid") * 3).alias("poc"), "idr")
    return references.bounded_output(x, DISPLAY)


QUERIES["bounded_output"] = bounded_output
ORACLE_SQL["bounded_output"] = f"""WITH RECURSIVE {sql('slices')}, s AS (SELECT stream_id, n, lsb * 5 % 16 + tid * 3 AS poc, idr, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i, count(*) OVER (PARTITION BY stream_id) AS last FROM slices),
step(stream_id, i, held, base, out) AS (
  SELECT DISTINCT stream_id, 0::BIGINT, []::STRUCT(poc BIGINT, n BIGINT)[], 0::BIGINT, []::STRUCT(poc BIGINT, n BIGINT, at BIGINT, no BIGINT)[] FROM s
  UNION ALL
  SELECT stream_id, i, list_sort(now)[greatest(len(now) - {DISPLAY}, 0) + 1:], b + greatest(len(now) - {DISPLAY}, 0),
    CASE WHEN idr THEN list_transform(held, lambda x, k: {{'poc': x.poc, 'n': x.n, 'at': NULL::BIGINT, 'no': base + k - 1}}) ELSE [] END
      || list_transform(list_sort(now)[:greatest(len(now) - {DISPLAY}, 0)], lambda x, k: {{'poc': x.poc, 'n': x.n, 'at': n, 'no': b + k - 1}})
  FROM (SELECT *, CASE WHEN idr THEN 0 ELSE base END AS b, CASE WHEN idr THEN [] ELSE held END || [{{'poc': poc, 'n': n}}] AS now
    FROM (SELECT s.stream_id, s.i, s.n, s.poc, s.idr, p.held, p.base FROM step p JOIN s ON s.stream_id = p.stream_id AND s.i = p.i + 1))),
ends AS (SELECT stream_id, list_transform(held, lambda x, k: {{'poc': x.poc, 'n': x.n, 'at': NULL::BIGINT, 'no': base + k - 1}}) AS out FROM step p WHERE i = (SELECT max(last) FROM s WHERE s.stream_id = p.stream_id)),
all_ AS (SELECT stream_id, unnest(out) AS o FROM (SELECT stream_id, out FROM step UNION ALL SELECT stream_id, out FROM ends))
SELECT stream_id, o.n AS n, o.poc AS poc, o.at AS shown_at, o.no AS shown_no FROM all_""".replace("'at'", "'seen'").replace(" at BIGINT", " seen BIGINT").replace("o.at", "o.seen")


def gap_references(spark, d):
    """References where the frame numbers of pictures leave gaps: missing frames are marked too."""
    x = _pictures(spark, d).withColumn("frame_num", F.when(C("idr"), 0).otherwise((C("lsb") * 3 + C("delta")) % 16))
    m = references.mark_references(references.frame_gaps(x, 4), 4, 4, "place")
    return m.select("stream_id", "n", F.array_join("short_term", ",").alias("short_term"), F.array_join("long_term", ",").alias("long_term"))


QUERIES["gap_references"] = gap_references
_GAPS = f"""{sql('slices')}, o AS (SELECT *, CASE WHEN idr OR n % 6 <> 0 THEN 0 ELSE n // 6 % 7 END AS op, CASE WHEN idr THEN 0 ELSE (lsb * 3 + tid) % 16 END AS f, sum(idr::INT) OVER (PARTITION BY stream_id ORDER BY n) AS run FROM slices),
q AS (SELECT *, last_value(CASE WHEN is_reference THEN CASE WHEN op = 5 THEN 0 ELSE f END END IGNORE NULLS) OVER (PARTITION BY stream_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM o),
g AS (SELECT *, CASE WHEN idr OR prev IS NULL THEN 0 ELSE greatest((f - prev + 16) % 16 - 1, 0) END AS missing FROM q),
e AS (SELECT *, unnest(range(0, missing + 1)) AS k FROM g),
s AS (SELECT stream_id, CASE WHEN k = missing THEN n ELSE -1 - (16 * n + k) END AS n, CASE WHEN k = missing THEN f ELSE (prev + 1 + k) % 16 END AS f, k < missing OR is_reference AS is_reference, k = missing AND idr AS idr,
  CASE WHEN k = missing THEN op ELSE 0 END AS op, CASE WHEN k = missing THEN n % 3 ELSE 0 END AS a, CASE WHEN k = missing THEN lsb % 3 ELSE 0 END AS b, row_number() OVER (PARTITION BY stream_id ORDER BY 16 * n + k) AS i FROM e)"""
ORACLE_SQL["gap_references"] = ORACLE_SQL["marked_references"].replace(_PICTURES, _GAPS).replace(ORACLE_SQL["marked_references"].split("FROM told")[0].rsplit("SELECT stream_id, n,", 1)[1], " array_to_string(seen_s, ',') AS short_term, array_to_string(seen_l, ',') AS long_term ")
