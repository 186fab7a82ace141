"""Queries of slice headers that are read bit by bit, and of reference lists changed by commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.coding import bits
from reelspark.operators import references, slice_headers
from reelspark.plans.references import ORACLE_SQL as _MARKED
from reelspark.plans.references import _pictures
from reelspark.sources.views import sql, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col

# The elements of each slice and the fields of its set, in an SQL that both engines read, but for div (Spark) and // (DuckDB).
_SETS = {
    "set_id": "set_id", "macroblocks": "396", "reference_frames": "4", "frame_num_bits": "4 + set_id", "order_type": "set_id % 2", "lsb_bits": "4 + set_id", "delta_zero": "false", "order_present": "set_id > 1",
    "top_to_bottom": "0", "redundant_present": "set_id = 1", "refs_active": "set_id + 1", "qp": "26 + set_id", "deblocking_present": "set_id <> 2", "cycle_bits": "CASE WHEN set_id = 3 THEN 5 ELSE 0 END", "cycle_most": "30",
}
_ELEMENTS = {
    "type": "CASE WHEN idr THEN 5 WHEN n % 97 = 13 THEN 6 ELSE 1 END", "ref": "CASE WHEN idr THEN 3 WHEN is_reference THEN 2 ELSE 0 END", "cut": "n % 19 = 6",
    "first_mb": "n % 400", "slice_type": "CASE WHEN idr THEN 7 WHEN n % 31 = 3 THEN 1 WHEN n % 5 = 1 THEN 2 WHEN n % 2 = 1 THEN 0 ELSE 5 END", "pps_id": "CASE WHEN n % 53 = 5 THEN set_id + 1 ELSE set_id END",
    "frame_num": "CASE WHEN n % 120 = 40 THEN 1 WHEN idr THEN 0 ELSE lsb END", "idr_pic_id": "n % 70000", "lsb": "CASE WHEN idr THEN 0 ELSE 15 - lsb END", "delta_bottom": "CASE WHEN idr THEN n % 160 DIV 120 - 0 ELSE tid - 1 END",
    "delta_0": "CASE WHEN idr THEN 0 ELSE n % 300 - 150 END", "delta_1": "CASE WHEN idr THEN 1 ELSE 7 - n % 16 END", "redundant": "n % 130", "override": "n % 2", "more": "CASE WHEN n % 101 = 7 THEN 16 ELSE n % 7 END",
    "changed": "CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END", "n_changes": "CASE WHEN n % 57 = 9 THEN 0 ELSE n DIV 3 % 3 + 1 END", "no_output": "n DIV 40 % 2", "long_term_idr": "n DIV 80 % 2", "adaptive": "lsb % 2", "n_marks": "n DIV 2 % 4",
    "qp_delta": "n % 51 - 26", "deblocking": "CASE WHEN n % 83 = 11 THEN 3 ELSE n % 3 END", "alpha": "n % 13 - 6", "beta": "CASE WHEN n % 71 = 2 THEN 7 ELSE n DIV 2 % 13 - 6 END", "group_cycle": "n % 32",
}
_CHANGE = ("(n + j) % 3", "(n * 7 + j * 5) % 18")
_MARK = ("1 + (n DIV 6 + j) % 6", "(n + j) % 6", "n DIV 5 % 6")


def _ue(value: Column) -> Column:
    body = F.bin(value.cast("bigint") + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(body) - 1), body)


def _se(value: Column) -> Column:
    return _ue(F.when(value > 0, 2 * value - 1).otherwise(-2 * value))


def _listed(count: str, terms: tuple[str, ...]) -> Column:
    """array<struct<op, a, b>>, `count` long, by terms in n and j."""
    one = f"named_struct('op', bigint({terms[0]}), 'a', bigint({terms[1]}), 'b', bigint({terms[2] if len(terms) > 2 else 'null'}))"
    return F.expr(f"CASE WHEN {count} > 0 THEN transform(sequence(0, int({count}) - 1), j -> {one}) ELSE cast(array() AS array<struct<op:bigint,a:bigint,b:bigint>>) END")


def _coded(s: Column) -> Column:
    """The bits of a slice's header with its stop bit, filled up to whole octets, written from its elements."""
    on = lambda test, *codes: F.when(test, F.concat(*codes)).otherwise("")
    idr, kept, p = C("type") == 5, C("ref") > 0, C("slice_type").isin(0, 5)
    joined = lambda a, code, end: F.concat(F.array_join(F.transform(a, code), ""), _ue(F.lit(end)))
    arguments = lambda m: F.concat(on(m["op"] != 5, _ue(m["a"])), on(m["op"] == 3, _ue(m["b"])))
    variable = lambda v, width: F.lpad(F.bin(v.cast("bigint")), width.cast("int"), F.lit("0"))
    text = F.concat(
        _ue(C("first_mb")), _ue(C("slice_type")), _ue(C("pps_id")), variable(C("frame_num"), s["frame_num_bits"]), on(idr, _ue(C("idr_pic_id"))),
        on(s["order_type"] == 0, variable(C("lsb"), s["lsb_bits"]), on(s["order_present"], _se(C("delta_bottom")))),
        on(s["order_type"] == 1, _se(C("delta_0")), on(s["order_present"], _se(C("delta_1")))), on(s["redundant_present"], _ue(C("redundant"))),
        on(p, bits(C("override"), 1), on(C("override") == 1, _ue(C("more"))), bits(C("changed"), 1), on(C("changed") == 1, joined(C("changes"), lambda m: F.concat(_ue(m["op"]), _ue(m["a"])), 3))),
        on(kept & idr, bits(C("no_output"), 1), bits(C("long_term_idr"), 1)),
        on(kept & ~idr, bits(C("adaptive"), 1), on(C("adaptive") == 1, joined(C("marks"), lambda m: F.concat(_ue(m["op"]), arguments(m)), 0))),
        _se(C("qp_delta")), on(s["deblocking_present"], _ue(C("deblocking")), on(C("deblocking") != 1, _se(C("alpha")), _se(C("beta")))),
        on(s["cycle_bits"] > 0, bits(C("group_cycle"), 5)), F.lit("1"),
    )
    return F.rpad(text, (F.ceil(F.length(text) / 8) * 8).cast("int"), "0")


def _unit(coded: Column) -> Column:
    """A slice's unit in hex. coded is to be a column that is worked out already: every part of it names it again."""
    part = lambda i: F.substring(coded, i, F.lit(32))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.length(coded), F.lit(32)), lambda i: F.lpad(F.conv(part(i), 2, 16), (F.length(part(i)) / 4).cast("int"), F.lit("0"))), "")
    # An octet of at most 3 after two zero octets has 03 before it.
    guarded = F.regexp_replace(body, r"\G((?:..)*?)0000(?=0[0-3])", "$1000003")
    head = F.lpad(F.hex(C("ref") * 32 + C("type")), 2, F.lit("0"))
    return F.concat(head, F.when(C("cut"), "").otherwise(guarded))


def h264_slice_headers(spark, d):
    """Headers of every slice, written bit by bit with emulation bytes and read back; faults by the first element that breaks a rule."""
    x = view(spark, d, "slices").repartition("n").selectExpr("stream_id", "n", *(f"{e} AS {k}" for k, e in _ELEMENTS.items()), "named_struct(" + ", ".join(f"'{k}', {e}" for k, e in _SETS.items()) + ") AS sets")
    x = x.withColumns({"changes": _listed("n_changes", _CHANGE), "marks": _listed("n_marks", _MARK)})
    units = x.withColumn("coded", _coded(C("sets"))).select("stream_id", "n", "sets", _unit(C("coded")).alias("unit"))
    said = lambda a: F.array_join(F.transform(a, lambda m: F.concat_ws(":", m["op"], m["a"], m["b"])), ",")
    out = slice_headers.read(units)
    return out.select("stream_id", "n", "fault", *(C(f"header.{f}").alias(f) for f in slice_headers.FIELDS), said(C("header.changes")).alias("changes"), said(C("header.marks")).alias("marks"))


QUERIES["h264_slice_headers"] = h264_slice_headers
_DUCK = lambda e: e.replace(" DIV ", " // ")
_P, _IDR = "slice_type IN (0, 5)", "type = 5"
_THERE = {
    "idr_pic_id": _IDR, "lsb": "order_type = 0", "delta_bottom": "order_type = 0 AND order_present", "delta_0": "order_type = 1", "delta_1": "order_type = 1 AND order_present", "redundant": "redundant_present", "active": _P,
    "no_output": "ref > 0 AND type = 5", "long_term_idr": "ref > 0 AND type = 5", "deblocking": "deblocking_present", "alpha": "deblocking_present AND deblocking <> 1", "beta": "deblocking_present AND deblocking <> 1", "group_cycle": "set_id = 3",
}
_OPS = lambda k: f"len(list_filter(marks, lambda m: m.op = {k}))"
ORACLE_SQL["h264_slice_headers"] = f"""WITH {sql('slices')},
w AS (SELECT stream_id, n, {', '.join(f'{_DUCK(e)} AS {k}' for k, e in _ELEMENTS.items())}, {', '.join(f'{e} AS {k}' for k, e in _SETS.items())} FROM slices),
v AS (SELECT *, CASE WHEN override = 1 THEN more + 1 ELSE refs_active END AS active, ref > 0 AND type <> 5 AND adaptive = 1 AS marked, {_P} AND changed = 1 AS listed,
  list_transform(range(0, n_changes), lambda j: {{'op': {_CHANGE[0]}, 'a': {_CHANGE[1]}}}) AS changes,
  list_transform(range(0, n_marks), lambda j: {{'op': {_DUCK(_MARK[0])}, 'a': CASE WHEN {_DUCK(_MARK[0])} <> 5 THEN {_MARK[1]} END, 'b': CASE WHEN {_DUCK(_MARK[0])} = 3 THEN {_DUCK(_MARK[2])} END}}) AS marks FROM w),
f AS (SELECT *, CASE WHEN type = 6 THEN 'no slice' WHEN cut THEN 'end' WHEN first_mb >= macroblocks THEN 'first_mb' WHEN slice_type = 1 THEN 'slice_type' WHEN pps_id <> set_id THEN 'set_id' WHEN {_IDR} AND frame_num <> 0 THEN 'frame_num'
  WHEN {_IDR} AND idr_pic_id > 65535 THEN 'idr_pic_id' WHEN {_IDR} AND order_type = 0 AND order_present AND least(0, delta_bottom) <> 0 THEN 'order' WHEN redundant_present AND redundant > 127 THEN 'redundant' WHEN {_P} AND active > 16 THEN 'active'
  WHEN listed AND (n_changes = 0 OR n_changes > active OR len(list_filter(changes, lambda m: m.op < 2 AND m.a >= 1 << frame_num_bits)) > 0) THEN 'changes'
  WHEN marked AND (n_marks > 10 OR len(list_filter(marks, lambda m: m.op = 4 AND m.a > 4)) > 0 OR {_OPS(4)} > 1 OR {_OPS(5)} > 1 OR {_OPS(6)} > 1 OR ({_OPS(5)} > 0 AND {_OPS(1)} + {_OPS(2)} + {_OPS(3)} > 0)) THEN 'marks'
  WHEN qp + qp_delta NOT BETWEEN 0 AND 51 THEN 'qp' WHEN deblocking_present AND (deblocking > 2 OR (deblocking <> 1 AND (abs(alpha) > 6 OR abs(beta) > 6))) THEN 'deblocking' WHEN set_id = 3 AND group_cycle > cycle_most THEN 'group_cycle' END AS fault FROM v)
SELECT stream_id, n, fault, {', '.join(f"CASE WHEN fault IS NULL AND {_THERE.get(k, 'true')} THEN {k} END AS {k}" for k in slice_headers.FIELDS)},
  CASE WHEN fault IS NULL AND listed THEN array_to_string(list_transform(changes, lambda m: m.op || ':' || m.a), ',') END AS changes,
  CASE WHEN fault IS NULL AND marked THEN array_to_string(list_transform(marks, lambda m: m.op || coalesce(':' || m.a, '') || coalesce(':' || m.b, '')), ',') END AS marks FROM f"""


_MOVES = ("(n + j) % 3", "CASE WHEN (n + j) % 3 = 2 THEN (n + j) % 2 ELSE (n * 3 + j * 5) % 7 END")


def changed_lists(spark, d):
    """Reference lists of five places after up to three commands that name pictures by differences and long-term numbers; null where one is not there."""
    x = _pictures(spark, d).selectExpr("stream_id", "n", "frame_num")
    m = references.mark_references(_pictures(spark, d), 4, 4).join(x, ["stream_id", "n"])
    named = lambda numbers, pictures: F.arrays_zip(C(numbers).alias("number"), C(pictures).alias("picture"))
    changed = slice_headers.changed_list(named("short_numbers", "short_term"), named("long_numbers", "long_term"), C("frame_num"), F.lit(5), _listed("n % 4", _MOVES), 16)
    return m.select("stream_id", "n", F.array_join(changed, ",", "-").alias("list0"))


QUERIES["changed_lists"] = changed_lists
_STEPS = _MARKED["marked_references"].split("\ntold AS")[0]
for _had, _has in (
    ("[]::BIGINT[], []::BIGINT[] FROM s", "[]::STRUCT(w BIGINT, n BIGINT)[], []::STRUCT(i BIGINT, n BIGINT)[] FROM s"),
    (", lambda x: x.n), list_transform(list_sort(l0), lambda x: x.n)\n", ", list_sort(l0)\n"),
    ("    list_transform(list_sort(list_transform(s0", "    list_sort(list_transform(s0"),
):
    assert _had in _STEPS
    _STEPS = _STEPS.replace(_had, _has)
ORACLE_SQL["changed_lists"] = f"""{_STEPS}
firsts AS (SELECT p.stream_id, p.n, f, seen_s, seen_l, (list_transform(seen_s, lambda x: x.n) || list_transform(seen_l, lambda x: x.n) || [NULL, NULL, NULL, NULL, NULL]::BIGINT[])[1:5] AS r FROM step p JOIN s ON s.stream_id = p.stream_id AND s.n = p.n WHERE p.i > 0),
moved(stream_id, n, j, f, last, r, seen_s, seen_l) AS (
  SELECT stream_id, n, 0::BIGINT, f, f, r, seen_s, seen_l FROM firsts
  UNION ALL
  SELECT stream_id, n, j + 1, f, CASE WHEN op = 2 THEN last ELSE t END, CASE WHEN p IS NOT NULL THEN (r[1:j] || [p] || list_filter(r[j + 1:5], lambda q: q IS DISTINCT FROM p))[1:5] END, seen_s, seen_l
  FROM (SELECT *, CASE WHEN op = 2 THEN list_filter(seen_l, lambda x: x.i = a)[1].n ELSE list_filter(seen_s, lambda x: -x.w = CASE WHEN t > f THEN t - 16 ELSE t END)[1].n END AS p
    FROM (SELECT *, ((last + CASE WHEN op = 1 THEN a + 1 ELSE -a - 1 END) % 16 + 16) % 16 AS t FROM (SELECT *, {_MOVES[0]} AS op, {_MOVES[1]} AS a FROM moved WHERE j < n % 4))))
SELECT stream_id, n, array_to_string(list_transform(r, lambda q: coalesce(q::VARCHAR, '-')), ',') AS list0 FROM moved WHERE j = n % 4"""
