"""Slice headers of random bits and changed lists, against scalar forms."""

import random

from pyspark.sql import functions as F

from reelspark.operators import slice_headers

SETS = {
    "set_id": 0, "macroblocks": 396, "reference_frames": 2, "frame_num_bits": 4, "order_type": 0, "lsb_bits": 5, "delta_zero": False, "order_present": True, "top_to_bottom": 1,
    "redundant_present": True, "refs_active": 3, "qp": 26, "deblocking_present": True, "cycle_bits": 3, "cycle_most": 5,
}
SCHEMA = "id int, unit string, sets struct<set_id:int,macroblocks:int,reference_frames:int,frame_num_bits:int,order_type:int,lsb_bits:int,delta_zero:boolean,order_present:boolean,top_to_bottom:int,redundant_present:boolean,refs_active:int,qp:int,deblocking_present:boolean,cycle_bits:int,cycle_most:int>"


class Fault(Exception):
    pass


def scalar(unit, s):
    """(fields, changes, marks) of a unit, or Fault with the first fault's name."""
    body, out, zeros = bytes.fromhex(unit[2:]), [], 0
    for b in body:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    text, at = "".join(f"{b:08b}" for b in out), 0
    kind, ref = int(unit[:2], 16) % 32, int(unit[:2], 16) >> 5 & 3

    def check(broken, name):
        if broken:
            raise Fault(name)

    def u(n):
        nonlocal at
        check(at + n > len(text), "end")
        at += n
        return int(text[at - n : at] or "0", 2)

    def ue():
        nonlocal at
        one = text.find("1", at)
        check(one < 0 or one - at > 32, "end")
        zeros, at = one - at, one
        return u(zeros + 1) - 1

    def se():
        v = ue()
        return (v + 1) // 2 if v % 2 else -(v // 2)

    check(kind not in (1, 5), "no slice")
    idr, h = kind == 5, dict.fromkeys(slice_headers.FIELDS)
    h["first_mb"] = ue()
    check(h["first_mb"] >= s["macroblocks"], "first_mb")
    h["slice_type"] = t = ue()
    p = t in (0, 5)
    check(t not in (0, 2, 5, 7) or (p and (idr or not s["reference_frames"])), "slice_type")
    h["pps_id"] = ue()
    check(h["pps_id"] != s["set_id"], "set_id")
    h["frame_num"] = u(s["frame_num_bits"])
    check(idr and h["frame_num"], "frame_num")
    if idr:
        h["idr_pic_id"] = ue()
        check(h["idr_pic_id"] > 65535, "idr_pic_id")
    if s["order_type"] == 0:
        h["lsb"] = u(s["lsb_bits"])
        if s["order_present"]:
            h["delta_bottom"] = se()
        check(idr and (h["lsb"] > 1 << s["lsb_bits"] - 1 or min(h["lsb"], h["lsb"] + (h["delta_bottom"] or 0)) != 0), "order")
    if s["order_type"] == 1 and not s["delta_zero"]:
        h["delta_0"] = se()
        if s["order_present"]:
            h["delta_1"] = se()
        check(idr and min(h["delta_0"], h["delta_0"] + s["top_to_bottom"] + (h["delta_1"] or 0)) != 0, "order")
    if s["redundant_present"]:
        h["redundant"] = ue()
        check(h["redundant"] > 127, "redundant")
    changes = marks = None
    if p:
        h["active"] = ue() + 1 if u(1) else s["refs_active"]
        check(h["active"] > 16, "active")
        if u(1):
            changes = []
            while True:
                check(len(changes) > h["active"], "changes")
                op = ue()
                check(op > 3, "changes")
                if op == 3:
                    break
                a = ue()
                check(op < 2 and a >= 1 << s["frame_num_bits"], "changes")
                changes.append((op, a, None))
            check(not changes, "changes")
    if ref and idr:
        h["no_output"], h["long_term_idr"] = u(1), u(1)
        check(h["long_term_idr"] and not s["reference_frames"], "marks")
    elif ref and u(1):
        marks = []
        while True:
            check(len(marks) > 2 * s["reference_frames"] + 2, "marks")
            op = ue()
            check(op > 6, "marks")
            if op == 0:
                break
            a = ue() if op != 5 else None
            marks.append((op, a, ue() if op == 3 else None))
            check(op == 4 and a > s["reference_frames"], "marks")
        ops = [m[0] for m in marks]
        check(any(ops.count(k) > 1 for k in (4, 5, 6)) or (5 in ops and any(k in ops for k in (1, 2, 3))), "marks")
    h["qp_delta"] = se()
    check(not 0 <= h["qp_delta"] + s["qp"] <= 51, "qp")
    if s["deblocking_present"]:
        h["deblocking"] = ue()
        check(h["deblocking"] > 2, "deblocking")
        if h["deblocking"] != 1:
            h["alpha"], h["beta"] = se(), se()
            check(abs(h["alpha"]) > 6 or abs(h["beta"]) > 6, "deblocking")
    if s["cycle_bits"]:
        h["group_cycle"] = u(s["cycle_bits"])
        check(h["group_cycle"] > s["cycle_most"], "group_cycle")
    return h, changes, marks


def code(v):
    return "0" * ((v + 1).bit_length() - 1) + f"{v + 1:b}"


def drawn(rng, s):
    """A unit of plausible codes, often broken somewhere, now and then cut."""
    idr, ref = rng.random() < 0.25, rng.randrange(4)
    t = rng.choice([2, 7]) if idr else rng.choice([0, 5, 5, 2])
    text = code(rng.randrange(390)) + code(t) + code(s["set_id"]) + ("0000" if idr else f"{rng.randrange(16):04b}") + (code(rng.randrange(70000)) if idr else "")
    if s["order_type"] == 0:
        text += ("00000" if idr else f"{rng.randrange(32):05b}") + (code(0 if idr else rng.randrange(6)) if s["order_present"] else "")
    elif s["order_type"] == 1 and not s["delta_zero"]:
        text += code(0 if idr else rng.randrange(6)) + (code(rng.randrange(4)) if s["order_present"] else "")
    text += code(rng.randrange(4)) if s["redundant_present"] else ""
    if t in (0, 5):
        text += rng.choice(["0", "1" + code(rng.randrange(16))])
        text += rng.choice(["0", "1" + "".join(code(rng.randrange(3)) + code(rng.randrange(16)) for _ in range(rng.randrange(1, 4))) + code(3)])
    if ref:
        marks = [(k, *(rng.randrange(4) for _ in range(slice_headers.ARGUMENTS[k]))) for k in (rng.randrange(1, 7) for _ in range(rng.randrange(4)))]
        text += rng.choice(["00", "01", "10"]) if idr else rng.choice(["0", "1" + "".join(code(v) for m in marks for v in m) + code(0)])
    text += code(rng.randrange(50)) + code(rng.randrange(3)) + code(rng.randrange(12)) + code(rng.randrange(12)) + f"{rng.randrange(6):03b}1"
    if rng.random() < 0.3:
        k = rng.randrange(len(text))
        text = text[:k] + ("1" if text[k] == "0" else "0") + text[k + 1 :]
    text = text[: rng.randrange(len(text))] if rng.random() < 0.15 else text
    text += "0" * (-len(text) % 8)
    body, zeros = "", 0
    for i in range(0, len(text), 8):
        b = int(text[i : i + 8], 2)
        if zeros == 2 and b <= 3:
            body, zeros = body + "03", 0
        body, zeros = body + f"{b:02x}", zeros + 1 if b == 0 else 0
    return f"{ref << 5 | (5 if idr else 1):02x}{body}".upper()


def test_headers_of_random_bits_equal_a_scalar_reader(spark):
    rng = random.Random(3)
    kinds = [SETS, SETS | {"order_type": 1, "redundant_present": False}, SETS | {"order_type": 2, "cycle_bits": 0, "reference_frames": 16}, SETS | {"order_present": False, "deblocking_present": False, "reference_frames": 0}]
    rows = [(drawn(rng, s), s) for s in kinds for _ in range(250)] + [(f"{rng.choice([1, 5, 33, 37, 101]):02x}{rng.randbytes(rng.randrange(12)).hex()}".upper(), rng.choice(kinds)) for _ in range(300)]
    rows += [("41" + "00" * 9, SETS), ("65", SETS), ("67" + "88" * 5, SETS)]
    x = spark.createDataFrame([(i, r[0], tuple(r[1].values())) for i, r in enumerate(rows)], SCHEMA).withColumn("fault", F.lit("clash"))
    got = {r.id: r for r in slice_headers.read(x).collect()}
    good = 0
    for i, (unit, s) in enumerate(rows):
        try:
            h, changes, marks = scalar(unit, s)
        except Fault as f:
            assert (got[i].fault, got[i].header) == (str(f), None), (unit, s)
            continue
        assert got[i].fault is None, (unit, s, got[i].fault)
        told = got[i].header.asDict()
        listed = lambda a: a if a is None else [tuple(m) for m in a]
        assert (listed(told.pop("changes")), listed(told.pop("marks"))) == (changes, marks)
        assert told == h
        good += 1
    assert good > 200


def test_headers_without_units_or_sets(spark):
    x = spark.createDataFrame([(1, None, tuple(SETS.values())), (2, "4188", None), (3, "", tuple(SETS.values()))], SCHEMA)
    assert {(r.id, r.fault, r.header) for r in slice_headers.read(x).collect()} == {(k, "no slice", None) for k in (1, 2, 3)}
    assert slice_headers.read(x.limit(0)).collect() == []


def moved(short, long, frame, active, commands, wrap):
    out = ([p for _, p in short] + [p for _, p in long] + [None] * active)[:active]
    last = frame
    for at, (op, a) in enumerate(commands):
        if op == 2:
            picture = dict(long).get(a)
        else:
            last = (last + (a + 1 if op else -a - 1)) % wrap
            picture = dict(short).get(last - wrap if last > frame else last)
        if picture is None:
            return None
        out = (out[:at] + [picture] + [p for p in out[at:] if p != picture])[:active]
    return out


def test_changed_lists_equal_a_scalar_form(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        frame = rng.randrange(16)
        numbers = sorted(rng.sample(range(frame - 15, frame), rng.randrange(5)), reverse=True)
        short, long = [(k, 100 + k) for k in numbers], [(k, 200 + k) for k in sorted(rng.sample(range(4), rng.randrange(3)))]
        last, commands = frame, []
        for _ in range(rng.randrange(4)):
            op, a = rng.choice([0, 0, 1, 2]), rng.randrange(5)
            if rng.random() < 0.9 and (long if op == 2 else short):
                # A command to a picture that is there, most of the time.
                k = rng.choice(long if op == 2 else short)[0]
                a = k if op == 2 else ((k - last if op else last - k) - 1) % 16
            last = last if op == 2 else (last + (a + 1 if op else -a - 1)) % 16
            commands.append((op, a, None))
        rows.append((i, short, long, frame, rng.randrange(1, 7), commands))
    pair = "array<struct<number:bigint,picture:bigint>>"
    x = spark.createDataFrame(rows, f"id int, short {pair}, long {pair}, frame int, active int, changes array<struct<op:bigint,a:bigint,b:bigint>>")
    got = {r.id: r.l for r in x.select("id", slice_headers.changed_list(F.col("short"), F.col("long"), F.col("frame"), F.col("active"), F.col("changes"), 16).alias("l")).collect()}
    want = {i: moved(s, g, f, a, [c[:2] for c in cs], 16) for i, s, g, f, a, cs in rows}
    assert got == want
    assert sum(v is not None and bool(rows[k][5]) for k, v in want.items()) > 40


def guarded(bits):
    body, zeros = "", 0
    for i in range(0, len(bits), 8):
        b = int(bits[i : i + 8].ljust(8, "0"), 2)
        if zeros == 2 and b <= 3:
            body, zeros = body + "03", 0
        body, zeros = body + f"{b:02x}", zeros + 1 if b == 0 else 0
    return body.upper()


def test_long_lists_zero_runs_and_cut_orders_equal_a_scalar_reader_in_batches_of_any_size(spark):
    rng, s = random.Random(7), SETS | {"reference_frames": 16}
    head = code(3) + code(0) + code(0) + "0101" + "00011" + code(2) + code(0)

    def long_lists():
        changes = "".join(code(rng.randrange(3)) + code(rng.randrange(16)) for _ in range(rng.randrange(13, 20))) + code(3)
        marks = "".join(code(v) for _ in range(rng.randrange(28, 40)) for v in (3, rng.randrange(3), rng.randrange(3))) + code(0)
        return "61" + guarded(head + "1" + code(rng.choice([14, 15])) + "1" + changes + "1" + marks + code(0) + code(1) + "0001")

    rows = [(long_lists(), s) for _ in range(60)]
    rows += [("61" + "".join(rng.choice(["00", "00", "00", "03", "01", "80"]) for _ in range(rng.randrange(30))), s) for _ in range(200)]
    # An IDR slice whose order count is not decided where its bits end.
    cut = (guarded(code(0) + code(7) + code(0) + "0000" + code(0) + "00001" + "0" * 6), SETS)
    rows += [("65" + cut[0], SETS)]
    x = spark.createDataFrame([(i, r[0], tuple(r[1].values())) for i, r in enumerate(rows)], SCHEMA).repartition(2)
    want = []
    for unit, k in rows:
        try:
            want.append((None, scalar(unit, k)))
        except Fault as f:
            want.append((str(f), None))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("7", size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.id: r for r in slice_headers.read(x).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for i, (fault, told) in enumerate(want):
            assert got[i].fault == fault, rows[i]
            if told:
                h = got[i].header.asDict()
                assert [[tuple(m) for m in h.pop(k)] for k in ("changes", "marks")] == list(told[1:]) and h == told[0]
    assert want[-1][0] == "end" and {w[0] for w in want} >= {None, "changes", "marks", "end"}


def test_the_query_of_headers_folds_nothing_row_by_row(spark):
    from reelspark.plans import slices

    plan = slices.h264_slice_headers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1
    # A header's bits are put together once, in a column that the octets are cut from.
    assert plan.count("rpad(") == 1
