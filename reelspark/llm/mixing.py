"""Mixing sources to target weights by Pfair scheduling.

Blocks of a source with weight w have windows: block j (from 1) is released at slot floor((j-1)/w) and due by slot
ceil(j/w). Earliest-deadline-first over released blocks meets every window on one lane of slots, so at every slot each
source that still has blocks has been served within less than one block of its weight. Weights are whole shares of
their sum M; windows repeat every M slots, and so the schedule of one period, whose length is a parameter and not data,
gives the slot of every block by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.shared import fresh, written

#: The largest sum of shares: the period of the schedule, computed in one expression.
MAX_PERIOD = 4096
#: Hex digits of the shuffling key that number rows in pieces: 16**3 pieces of every source.
PIECE_DIGITS = 3
#: An id of more than this share of all rows, and of so many rows at least, is numbered in ranges of its rows: at most 4096 ids.
HOT_SHARE, HOT_ROWS = 1 / 4096, 100_000


def one_period(shares: list[int]) -> Column:
    """array<int> with, for every slot of a period, the index of the source that EDF serves there."""
    total = sum(shares)
    weights = F.array(*[F.lit(int(s)) for s in shares])
    sources = F.sequence(F.lit(0), F.lit(len(shares) - 1))

    def step(acc: Column, t: Column) -> Column:
        # Of each source's next block (done + 1): released by now? then (deadline, source); the least is served.
        ready = F.transform(
            F.filter(sources, lambda s: F.floor(F.get(acc["done"], s) * total / F.get(weights, s)) <= t),
            lambda s: F.struct(F.ceil((F.get(acc["done"], s) + 1) * total / F.get(weights, s)).alias("due"), s.alias("s")),
        )
        chosen = F.array_min(ready)["s"]
        return F.struct(
            F.transform(acc["done"], lambda d, i: d + F.when(i == chosen, 1).otherwise(0)).alias("done"),
            F.concat(acc["out"], F.array(chosen)).alias("out"),
        )

    start = F.struct(F.array_repeat(F.lit(0), len(shares)).alias("done"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, step, lambda acc: acc["out"])


def _pieces(keyed: DataFrame, id_col: str, lane: str, key: str, piece: str, ties: list[Column]) -> DataFrame:
    """keyed with piece: pieces of a lane ascend as their rows do in the order of key, id and ties.

    Rows of an id that holds a large share of all rows are dealt and sorted by ranges and written; their pieces stand
    inside the piece of their key's first digits, and the keys after them there are a piece of their own.
    """
    digits = F.substring(key, 1, PIECE_DIGITS)
    counts = keyed.groupBy(F.col(id_col).alias("id")).count()
    most = counts.agg(F.max("count"), F.sum("count")).first()
    least = max((most[1] or 0) * HOT_SHARE, HOT_ROWS)
    if (most[0] or 0) <= least:
        return keyed.withColumn(piece, digits)
    hot = F.broadcast(counts.where(F.col("count") > least).select("id"))
    same = F.col(id_col).eqNullSafe(F.col("id"))
    row, tie = fresh(keyed, "row"), fresh(keyed, "tie")
    order = [lane, key, tie, row]
    apart = written(keyed.join(hot, same, "left_semi").withColumns({row: F.monotonically_increasing_id(), tie: ties[0] if ties else F.lit(0)}), "mix-hot")
    apart = written(apart.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(piece, F.concat(F.col(key), F.lit(":"), F.lpad(F.spark_partition_id().cast("string"), 8, "0"))), "mix-hot-order")
    keys = sorted(r[0] for r in apart.select(key).distinct().collect())
    before = F.array_max(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: (k < F.col(key)) & k.startswith(digits)))
    others = keyed.join(hot, same, "left_anti").withColumn(piece, F.coalesce(F.concat(before, F.lit("~")), digits))
    return others.unionByName(apart.drop(row, tie))


def mix(
    docs: DataFrame,
    shares: dict[str, int],
    rest_share: int = 1,
    block_rows: int = 16,
    source_col: str = "source",
    id_col: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """docs with stream, block, slot and place_in_block (longs; such columns are replaced): order by slot, place_in_block.

    shares maps sources to whole numbers; sources without one, null among them, form one stream '*' with rest_share.
    Rows of a stream are taken in the order of md5(seed, id), then of the other columns' hash, and cut into blocks of
    block_rows. Every row is kept once; when a stream has ended, its slots stay empty, so slots have gaps from there on.
    Rows that are equal in all columns may swap places. Null ids are numbered like others; one id, or null, may stand on
    any share of the rows. An empty table stays empty.
    """
    if not shares or min([*shares.values(), rest_share]) < 1 or sum(shares.values()) + rest_share > MAX_PERIOD:
        raise ValueError(f"shares must be whole numbers from 1, with a sum of at most {MAX_PERIOD}")
    names = [*sorted(shares), "*"]
    counts = [*(shares[n] for n in names[:-1]), rest_share]
    total = sum(counts)
    docs = docs.drop("stream", "block", "slot", "place_in_block")
    key, piece, lane, at, o_lane, o_piece, o_at, o_s, o_slots = (fresh(docs, x) for x in ("key", "piece", "lane", "at", "o_lane", "o_piece", "o_at", "o_s", "o_slots"))

    lanes = F.create_map(*[x for i, n in enumerate(names[:-1]) for x in (F.lit(n), F.lit(i))])
    keyed = docs.withColumn(lane, F.coalesce(F.get(F.array(*[F.lit(i) for i in range(len(names))]), lanes[F.col(source_col)]), F.lit(len(names) - 1)))
    keyed = keyed.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))))
    ties = [F.xxhash64(*[F.col(c) for c in docs.columns])] if len(docs.columns) > 1 else []
    keyed = _pieces(keyed, id_col, lane, key, piece, ties)
    # Rows are numbered inside a piece of a stream, and pieces by their sizes: 16**PIECE_DIGITS rows a stream.
    pieces = keyed.groupBy(lane, piece).count()
    before = F.sum("count").over(Window.partitionBy(lane).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(F.col(lane).alias(o_lane), F.col(piece).alias(o_piece), F.coalesce(before, F.lit(0)).alias(o_at))
    inside = Window.partitionBy(lane, piece).orderBy(F.col(key), F.col(id_col), *ties)
    numbered = keyed.withColumn(at, F.row_number().over(inside) - 1)
    numbered = numbered.join(offsets, (F.col(lane) == F.col(o_lane)) & (F.col(piece) == F.col(o_piece)))
    row = F.col(o_at) + F.col(at)
    share = F.get(F.array(*[F.lit(c).cast("bigint") for c in counts]), F.col(lane))
    # The n-th slot of source s in a period, for all s: one literal-sized array per source.
    schedule = docs.sparkSession.range(1).select(one_period(counts).alias("order"))
    slots = schedule.select(F.posexplode("order").alias("slot", "s")).groupBy("s").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    placed = numbered.withColumn(at, row).join(F.broadcast(slots.toDF(o_s, o_slots)), F.col(lane) == F.col(o_s))
    block = F.floor(F.col(at) / block_rows)
    return placed.select(
        *[F.col(c) for c in docs.columns],
        F.get(F.array(*[F.lit(n) for n in names]), F.col(lane)).alias("stream"),
        block.alias("block"),
        (F.floor(block / share) * total + F.get(F.col(o_slots), F.pmod(block, share).cast("int"))).alias("slot"),
        F.pmod(F.col(at), F.lit(block_rows)).cast("bigint").alias("place_in_block"),
    )
