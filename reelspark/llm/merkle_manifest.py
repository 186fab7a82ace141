"""Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups' roots.

A row's leaf is the SHA-256 of its columns. Leaves are numbered in their group by ranges, so no group is one task. A level
partitions its nodes by group and parent; the ordered full-frame list of a run is the parent's preimage and holds the
siblings of each node. One row of each run goes up as the parent. Proofs come down again level by level: a node's
siblings, then its parent's proof. Every level is a third of the one below, so all levels shuffle half as much as the leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.shared import written

#: Consecutive nodes that become one.
FAN = 3
PROOF = "array<struct<left:binary,right:binary>>"


def said(columns: Sequence[str | Column]) -> Column:
    """A row's preimage: each value as UTF-8 byte count, colon, value; a null as '-'. No two different rows have the same one."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def leaf(columns: Sequence[str | Column]) -> Column:
    """Lowercase hex SHA-256 of a row."""
    return F.sha2(said(columns), 256)


def hexed(digests: Column) -> Column:
    """The digests of an array<binary> as one lowercase hex text."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def numbered(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """rows with grp, at and n: the place of the row's group among all groups, of the row in its group, and the group's rows.

    keys order the rows, nulls first; group is the first of them. Rows are dealt and sorted by ranges of the keys, so that
    a group of any size has many tasks; ranges are numbered by their sizes, one row for each range and group.
    """
    in_order = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    in_order = written(in_order.withColumn("pid", F.shiftrightunsigned("mid", 33)), "merkle-order")
    pieces = written(in_order.groupBy("pid", group).agg(F.min("mid").alias("head"), F.count("*").alias("size")), "merkle-pieces")
    before = F.sum("size").over(Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    groups = pieces.groupBy(group).agg(F.sum("size").alias("n"))
    # Groups are numbered by ranges too: there may be as many as rows.
    dealt = written(groups.repartitionByRange(group).sortWithinPartitions(group).withColumn("gid", F.monotonically_increasing_id()), "merkle-groups")
    ranges = dealt.groupBy(F.shiftrightunsigned("gid", 33).alias("gp")).agg(F.count("*").alias("held"))
    ranges = ranges.select("gp", F.coalesce(F.sum("held").over(Window.orderBy("gp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = dealt.join(ranges, F.shiftrightunsigned("gid", 33) == F.col("gp"))
    placed = placed.select(F.col(group).alias("g"), "n", (F.col("first") + F.col("gid").bitwiseAND((1 << 33) - 1)).alias("grp"))
    starts = pieces.withColumn("start", F.coalesce(before, F.lit(0))).join(placed, F.col(group).eqNullSafe(F.col("g")))
    starts = starts.select(F.col("pid").alias("s_pid"), F.col("g"), "grp", "n", (F.col("start") - F.col("head")).alias("shift"))
    found = in_order.join(starts, (F.col("pid") == F.col("s_pid")) & F.col(group).eqNullSafe(F.col("g")))
    return found.select(*rows.columns, "grp", (F.col("mid") + F.col("shift")).alias("at"), "n")


def levels(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """Written levels of the trees over nodes (grp, at, n, digest and more), from the leaves up: with run, the digests of the node's run.

    most is the size of the largest group. Groups of one node need no level and are not in them.
    """
    out = []
    run = Window.partitionBy("grp", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while most > 1:
        level = nodes.where("n > 1").withColumn("parent", F.floor(F.col("at") / FAN)).withColumn("run", F.collect_list("digest").over(run))
        out.append(written(level, f"{label}-{len(out)}"))
        nodes, most = _parents(out[-1]), -(-most // FAN)
    return out


def _parents(level: DataFrame) -> DataFrame:
    """The nodes above a level: one row of each run."""
    return level.where(F.col("at") % FAN == 0).select("grp", F.col("parent").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), F.unhex(F.sha2(hexed(F.col("run")), 256)).alias("digest"))


def tops(leaves: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """(grp, height, digest): what remains of each group, and after how many levels."""
    out = leaves.where("n = 1").select("grp", F.lit(0).alias("height"), "digest")
    for k, level in enumerate(tree):
        out = out.union(_parents(level).where("n = 1").select("grp", F.lit(k + 1), "digest"))
    return out


def proofs(leaves: DataFrame, tree: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """leaves' carried columns with proof, the siblings from the leaf up, and the columns that above (grp, height, proof and more) has for the whole group."""
    more = [c for c in above.columns if c not in ("grp", "height", "proof")]
    begin = lambda k: above.where(F.col("height") == k).select(F.col("grp").alias("a_grp"), F.lit(0).cast("bigint").alias("a_at"), "proof", *more)
    place = (F.col("at") % FAN).cast("int")
    step = F.struct(_joined(F.slice("run", F.lit(1), place)).alias("left"), _joined(F.slice("run", place + 2, F.lit(FAN))).alias("right"))
    parents = None
    for k in range(len(tree) - 1, -1, -1):
        parents = begin(k + 1) if parents is None else parents.union(begin(k + 1))
        down = tree[k].join(parents, (F.col("grp") == F.col("a_grp")) & (F.col("parent") == F.col("a_at")))
        proof = F.concat(F.array(step), F.col("proof")).alias("proof")
        if k == 0:
            alone = leaves.where("n = 1").join(begin(0), F.col("grp") == F.col("a_grp"))
            return down.select(*carried, proof, *more).union(alone.select(*carried, "proof", *more))
        parents = down.select(F.col("grp").alias("a_grp"), F.col("at").alias("a_at"), proof, *more)
    return leaves.join(begin(0), F.col("grp") == F.col("a_grp")).select(*carried, "proof", *more)


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof give."""
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), acc, F.lower(F.hex(s["right"]))), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof as one hex text, from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")


def manifest(rows: DataFrame, columns: Sequence[str | Column], group_col: str, order_col: str, carried: Sequence[str] = ()) -> DataFrame:
    """(carried columns, leaf, subroot, root: hex; proof: PROOF) of every row.

    columns are what a leaf is of; carried columns may not be named like the others of the result. Leaves of a group ascend by order_col, then by their digests; nulls come first, rows
    of null group are one group, and equal rows are leaves each. While a group has several nodes, every FAN consecutive ones
    become their hash (the last run may be shorter); what remains is its subroot, and the subroots in the order of the
    groups give root in the same way. An empty table gives no rows. The root is the only value that the driver takes.
    """
    carried = list(carried)
    if {c.lower() for c in carried} & {"leaf", "subroot", "root", "proof"}:
        raise ValueError("carried columns may not be named leaf, subroot, root or proof")
    base = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(group_col).alias("g_key"), F.col(order_col).alias("o_key"), F.unhex(leaf(columns)).alias("digest"))
    # Ids of rows part equal rows among the ranges; written, they stay what they are.
    base = written(base.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    kept = [f"c{i}" for i in range(len(carried))]
    leaves = written(numbered(base, ["g_key", "o_key", "digest", "uid"], "g_key").select(*kept, "grp", "at", "n", "digest"), "merkle-level")
    most = leaves.agg(F.max("n"), F.max("grp")).first()
    tree = levels(leaves, most[0] or 0, "merkle-level")
    subroots = written(tops(leaves, tree), "merkle-subroots")
    second = subroots.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("at"), F.lit((most[1] or 0) + 1).cast("bigint").alias("n"), "digest", "height")
    upper = levels(second, (most[1] or 0) + 1, "merkle-upper")
    root = tops(second, upper).first()
    crown = second.limit(0).select("grp", F.lit(0).alias("height"), F.array().cast(PROOF).alias("proof"))
    if root is not None:
        crown = rows.sparkSession.createDataFrame([(0, len(upper), [])], f"grp bigint, height int, proof {PROOF}")
    above = proofs(second, upper, crown, ["at", "height", "digest"])
    above = above.select(F.col("at").alias("grp"), "height", "proof", F.col("digest").alias("subroot"))
    out = proofs(leaves, tree, above, [*kept, "digest"])
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)],
        F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(bytes(root["digest"]).hex() if root is not None else None).cast("string").alias("root"), "proof",
    )
