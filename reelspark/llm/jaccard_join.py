"""N-gram Jaccard join of documents by grouped prefixes.

Two documents link when their sets of distinct word shingles have a Jaccard likeness of at least the threshold. Sets
that link share a shingle among the first n - ceil(t n) + 1 in any fixed order; the order here puts widely shared
shingles last. Documents with the same prefix and size form one group; groups, not documents, meet at the shingles.
Of sets that meet first at places i and j of that order, the smaller rest, n - i or m - j, bounds what they share: groups
whose rests are too short for their sizes are no pair, however many share the shingle.
A chain of exact steps follows: stars inside every meeting are verified first and give components; then every pair of
sets that met but lies in different components is verified. So no link between different components is lost, and large
groups of near copies never expand into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reelspark.llm import shingles
from reelspark.llm.components import components
from reelspark.llm.shared import discard, fresh, small_batches, written

#: Link when PARTS[1] * intersection >= PARTS[0] * union.
PARTS = (75, 100)
SHINGLE_WORDS = 5
#: Shingles dealt out in one piece of a task: bounds the task's memory.
AT_ONCE = 500_000
#: A shingle of this many sets is widely shared. At most WIDE_SHINGLES of them, the commonest, go last in the order; any
#: choice gives the same links, and this bounds what is broadcast to 12 MB.
WIDE_FROM = 8
WIDE_SHINGLES = 1_000_000
#: Meetings at a shingle of this many sets are not put together in one task: their rows go on as they are.
HOT_FROM = 200_000
#: Document ids up to so many (16 bytes each) are broadcast when sets are fetched; more are shuffled.
BROADCAST_IDS = 1_000_000
#: Before all open pairs are verified: rounds in which sets of larger meetings meet about so many others, in one of so
#: many meetings. They change what is left to verify, not the links found.
ROUNDS, MEET, RUN_SHARE = 2, 4, 4
#: Stands for a null id.
NULL_ID = -(1 << 63)
#: Bits of a set's parity sketch: at least twice its size, between these bounds. The difference of two sketches never
#: exceeds that of the sets, so pairs that differ too much for their sizes cannot link.
SKETCH_BITS = (256, 1 << 17)


def _prefix_length(n: int) -> int:
    part, whole = PARTS
    return n - -(-part * n // whole) + 1 if n else 0


def _by_bucket(buckets: int, bucket: np.ndarray, entries: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(bucket, entries): one row for every bucket with entries, as bytes."""
    by = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[by], entries[by]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    used = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pa.array(used.astype(np.int32)), pa.array([entries[cuts[u] : cuts[u + 1]].tobytes() for u in used], pa.binary())


#: A shingle as it is counted: the upper 48 bits of its hash; one that a piece holds more than once has its number beside it.
CODE = np.dtype([("code", np.uint8, 6)])
COUNTED = np.dtype([("code", np.uint8, 6), ("n", np.uint32)])


def _codes(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, many, entries): the shingles of all sets of a piece, counted in it (CODE, COUNTED if many), equal sets of a piece once."""

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, n = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
        for many, kind in ((False, CODE), (True, COUNTED)):
            some = codes[(n > 1) == many]
            if len(some):
                entries = np.empty(len(some), kind)
                entries["code"] = some.view(np.uint8).reshape(-1, 8)[:, :6]
                if many:
                    entries["n"] = n[n > 1]
                bucket, packed = _by_bucket(buckets, (some % np.uint64(buckets)).astype(np.int64), entries)
                yield pa.RecordBatch.from_arrays([bucket, pa.array([many] * len(bucket)), packed], ["bucket", "many", "entries"])

    held, size, seen = [], 0, set()
    for batch in batches:
        for s in shingles.sets(batch.column("text"), SHINGLE_WORDS):
            ref = int(_hash_of(s, 1))
            if len(s) and ref not in seen:
                seen.add(ref)
                held.append(s)
                size += len(s)
                if size >= AT_ONCE:
                    yield from told(held)
                    held, size, seen = [], 0, set()
    if held:
        yield from told(held)


def _bucket_by_bucket(batches: Iterator[pa.RecordBatch], columns: tuple[str, str]) -> Iterator[list[tuple]]:
    """The rows of one bucket after the other, of batches sorted by bucket: a task holds one bucket, however many it has."""
    bucket, held = None, []
    for batch in batches:
        for b, *row in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and b != bucket:
                yield held
                held = []
            bucket = b
            held.append(tuple(row))
    if held:
        yield held


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of the shingles found at least WIDE_FROM times, of whole buckets, which come one after the other."""
    for rows in _bucket_by_bucket(batches, ("many", "entries")):
        found = [np.frombuffer(x, COUNTED if many else CODE) for many, x in rows]
        wide = np.zeros((sum(map(len, found)), 8), np.uint8)
        wide[:, :6] = np.concatenate([x["code"] for x in found])
        times = np.concatenate([x["n"].astype(np.int64) if "n" in x.dtype.names else np.ones(len(x), np.int64) for x in found])
        codes = wide.view(np.uint64).reshape(-1)
        by = np.argsort(codes, kind="stable")
        codes, times = codes[by], times[by]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        n = np.add.reduceat(times, first)
        often = n >= WIDE_FROM
        yield pa.RecordBatch.from_arrays([pa.array(codes[first][often].astype(np.int64)), pa.array(n[often])], ["code", "n"])


#: What a prefix shingle is dealt as: its hash, its group, the size of the group's sets, its place in their prefix.
ENTRY = np.dtype([("s", np.uint64), ("g", np.uint64), ("n", np.uint32), ("p", np.uint32)])


class _Order:
    """The order of shingles: those that are not wide by hash, then wide ones, rarer first."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.hot = np.sort(codes[counts >= HOT_FROM]).astype(np.uint64)
        rank = np.empty(len(codes), np.int64)
        rank[np.lexsort((codes, counts))] = np.arange(len(codes))
        by_code = np.argsort(codes)
        self.codes, self.ranks = codes[by_code].astype(np.uint64), rank[by_code].astype(np.uint32)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        length = _prefix_length(len(s))
        if not len(self.codes) or not len(s):
            return s[:length]
        codes = s >> np.uint64(16)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        wide = self.codes[at] == codes
        if not wide[: length + 1].any():
            return s[:length]
        rare = s[~wide]
        if len(rare) >= length:
            return rare[:length]
        common = s[wide][np.lexsort((s[wide], self.ranks[at[wide]]))]
        return np.concatenate([rare, common])[:length]


def _hash_of(s: np.ndarray, salt: int) -> np.uint64:
    return shingles.mixed(s.sum(dtype=np.uint64, keepdims=True) + np.array([(salt + len(s)) * shingles.BASE % (1 << 64)], np.uint64))[0]


def _sketch(s: np.ndarray) -> bytes:
    """Whether an odd number of hashes ends in each possible way, as bits."""
    low, high = SKETCH_BITS
    bits = min(max(1 << (2 * len(s) - 1).bit_length(), low), high)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs that may link by their sizes and sketches; the longer sketch is folded to the shorter's length."""
    part, whole = PARTS
    for batch in batches:
        keep = []
        for x, y, n, m in zip(batch.column("k_a"), batch.column("k_b"), batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            while len(x) != len(y):
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            apart = int(np.bitwise_count(x ^ y).sum())
            # The intersection is at most (n + m - apart) / 2, and links from part / (part + whole) of both sizes.
            keep.append((part + whole) * (n + m - apart) >= 2 * part * (n + m))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _describe(order, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, ref, grp, sketch): set size, hash of the set, hash of prefix and size, parity sketch; nulls for empty sets."""
    order = order.value
    for batch in batches:
        n, ref, grp, sketch = [], [], [], []
        for s in shingles.sets(batch.column("text"), SHINGLE_WORDS):
            n.append(len(s))
            if len(s):
                p = order.prefix(s)
                ref.append(_hash_of(s, 1).astype(np.int64))
                grp.append(_hash_of(p, 2 + len(s)).astype(np.int64))
                sketch.append(_sketch(s))
            else:
                ref.append(None)
                grp.append(None)
                sketch.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(ref, pa.int64()), pa.array(grp, pa.int64()), pa.array(sketch, pa.binary())],
            ["doc_id", "n", "ref", "grp", "sketch"],
        )


def _deal(order, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, hot, entries): for every bucket of prefix shingles, its entries (ENTRY) as bytes, repeated groups of a piece once.

    Entries of hot shingles are dealt by group too, so that no bucket has them all.
    """
    order = order.value

    def told(held: list, groups: list) -> Iterator[pa.RecordBatch]:
        lengths = [len(p) for p in held]
        out = np.empty(sum(lengths), ENTRY)
        out["s"] = np.concatenate(held)
        out["g"] = np.repeat(np.array([g for g, _ in groups], np.uint64), lengths)
        out["n"] = np.repeat(np.array([n for _, n in groups], np.uint32), lengths)
        out["p"] = np.concatenate([np.arange(length) for length in lengths])
        hot = np.isin(out["s"] >> np.uint64(16), order.hot)
        for which, key in ((False, out["s"]), (True, shingles.mixed(out["s"] ^ out["g"]))):
            if (hot == which).any():
                bucket, entries = _by_bucket(buckets, (key[hot == which] % np.uint64(buckets)).astype(np.int64), out[hot == which])
                yield pa.RecordBatch.from_arrays([bucket, pa.array([which] * len(bucket)), entries], ["bucket", "hot", "entries"])

    held, groups, size, seen = [], [], 0, set()
    for batch in batches:
        for s in shingles.sets(batch.column("text"), SHINGLE_WORDS):
            if not len(s):
                continue
            p = order.prefix(s)
            g = _hash_of(p, 2 + len(s))
            if g in seen:
                continue
            seen.add(g)
            held.append(p)
            groups.append((g, len(s)))
            size += len(p)
            if size >= AT_ONCE:
                yield from told(held, groups)
                held, groups, size, seen = [], [], 0, set()
    if held:
        yield from told(held, groups)


def _hopeful(e: np.ndarray) -> np.ndarray:
    """Entries, sorted by shingle and size, that may link with a set as small as the least of their shingle, meeting there first."""
    part, whole = PARTS
    first = np.flatnonzero(np.append(True, e["s"][1:] != e["s"][:-1]))
    least = np.repeat(e["n"][first], np.diff(np.append(first, len(e)))).astype(np.int64)
    n = e["n"].astype(np.int64)
    return e[(part + whole) * (n - e["p"]) >= part * (n + least)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, grp, n, p): groups that meet at a shingle with sizes near enough, under the hash of their list, or of the shingle if it is hot.

    Of equal lists the one at the first shingle in the order stands for all: its rests are the longest for every group.
    """
    def rows(run: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        columns = [run.view(np.int64), e["g"].copy().view(np.int64), e["n"].astype(np.int32), e["p"].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "grp", "n", "p"])

    part, whole = PARTS
    seen: dict[int, int] = {}
    for held in _bucket_by_bucket(batches, ("hot", "entries")):
        some = [np.frombuffer(x, ENTRY) for hot, x in held if not hot]
        for e in (np.frombuffer(x, ENTRY) for hot, x in held if hot):
            yield rows(shingles.mixed(e["s"]), e)
        if not some:
            continue
        e = np.concatenate(some)
        # Only shingles of two entries or more are sorted in full.
        shingle = np.sort(e["s"])
        twice = np.unique(shingle[1:][shingle[1:] == shingle[:-1]])
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, e["s"]), len(twice) - 1)
        e = e[twice[at] == e["s"]]
        e = e[np.lexsort((e["g"], e["n"], e["s"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["s"][1:] != e["s"][:-1]) | (e["g"][1:] != e["g"][:-1])
        e = _hopeful(e[new])
        if not len(e):
            continue
        cut = np.ones(len(e), bool)
        cut[1:] = (e["s"][1:] != e["s"][:-1]) | (part * e["n"][1:].astype(np.int64) > whole * e["n"][:-1].astype(np.int64))
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(e)))
        key = shingles.mixed(np.add.reduceat(shingles.mixed(e["g"]), first))
        place = e["p"][first]
        by = np.lexsort((place, key))
        pick = np.zeros(len(first), bool)
        pick[by[np.append(True, key[by][1:] != key[by][:-1])]] = True
        pick &= length > 1
        pick &= np.array([seen.get(k, p + 1) > p for k, p in zip(key.tolist(), place.tolist(), strict=True)], bool)
        seen.update(zip(key[pick].tolist(), place[pick].tolist(), strict=True))
        kept = np.repeat(pick, length)
        yield rows(np.repeat(key, length)[kept], e[kept])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose texts x and y have the sets asked for, and whose sets link."""
    part, whole = PARTS
    for batch in batches:
        keep = []
        both_sets = zip(shingles.sets(batch.column("x"), SHINGLE_WORDS), shingles.sets(batch.column("y"), SHINGLE_WORDS), strict=True)
        for (x, y), a, b in zip(both_sets, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            ok = whole * common >= part * (len(x) + len(y) - common)
            keep.append(bool(ok and _hash_of(x, 1).astype(np.int64) == a and _hash_of(y, 1).astype(np.int64) == b))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _small(ids: DataFrame) -> DataFrame:
    """ids, broadcast where they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


class _Join:
    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs, docs.sparkSession
        small_batches(self.spark)
        parts = self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = docs.select("text").mapInArrow(partial(_codes, 4 * parts), "bucket int, many boolean, entries binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
        wide = dealt.mapInArrow(_tally, "code bigint, n bigint").orderBy(F.desc("n"), "code").limit(WIDE_SHINGLES).toPandas()
        self.order = self.spark.sparkContext.broadcast(_Order(wide["code"].to_numpy(), wide["n"].to_numpy()))
        self.meta = written(docs.mapInArrow(partial(_describe, self.order), "doc_id bigint, n int, ref bigint, grp bigint, sketch binary"), "sets-meta")
        # Ids on several rows: their texts are told apart by the sets' hashes, which takes another hashing of these rows.
        self.several = written(self.meta.where("n > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "sets-several")
        self.repeated = not self.several.isEmpty()
        sketch = F.first("sketch")
        self.sets = written(
            self.meta.where("n > 0").groupBy("ref").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("grp").alias("grp"), sketch.alias("sketch")), "sets-distinct"
        )

    def runs(self) -> DataFrame:
        """(run, grp, n, p): the groups that meet, and the first place where they do."""
        dealt = self.docs.select("text").mapInArrow(partial(_deal, self.order, 4 * self.parts), "bucket int, hot boolean, entries binary")
        met = dealt.repartition(self.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "run bigint, grp bigint, n int, p int")
        return written(met.groupBy("run", "grp", "n").agg(F.min("p").alias("p")), "meetings")

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        """The linking pairs (a, b) among pairs of sets, by sizes, sketches and then the whole sets."""
        part, whole = PARTS
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().where("a <> b")
        side = lambda s: self.sets.select(F.col("ref").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"k_{s}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{part} * greatest(n_a, n_b) <= {whole} * least(n_a, n_b)")
        few = written(near.select("a", "b", "n_a", "n_b", "k_a", "k_b").mapInArrow(_sift, "a bigint, b bigint"), f"pairs-{label}")
        needed = few.select(F.col("a").alias("ref")).union(few.select("b")).distinct().join(self.sets.select("ref", "rep"), "ref").select("ref", F.col("rep").alias("doc_id"))
        # Texts travel, not sets: compressed, they are less than half as large.
        if not self.repeated:
            texts = self.docs.join(_small(needed), "doc_id").select("ref", "text")
        else:
            needed = written(needed, f"needed-{label}")
            single = needed.join(self.several, "doc_id", "left_anti")
            of_several = needed.join(self.several, "doc_id", "left_semi")
            # Of the rows of such ids each has its own set's hash before it is joined, and one text of a set goes on.
            own = self.docs.join(_small(of_several.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(partial(_with_ref, "text", "ref"), "doc_id bigint, text string, ref bigint")
            own = own.join(_small(of_several), ["doc_id", "ref"], "left_semi").groupBy("ref").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            texts = self.docs.join(_small(single), "doc_id").select("ref", "text").union(own)
        both = few.join(texts.select(F.col("ref").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("ref").alias("b"), F.col("text").alias("y")), "b")
        out = written(both.mapInArrow(_verify, "a bigint, b bigint"), f"links-{label}")
        discard(few)
        return out


def _placed_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[_Join, DataFrame]:
    """The join's tables, and (ref, rep, label) of every set with words: its least id and its component."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    join = _Join(docs)
    meetings = join.runs()
    sets = join.sets.select("ref", "grp", "n")
    # A group stands in its meetings by its least set; its other sets hang on that one.
    leads = sets.groupBy("grp").agg(F.min("ref").alias("lead"))
    inside = sets.join(leads, "grp").select(F.col("lead").alias("a"), F.col("ref").alias("b"))
    met = meetings.join(leads, "grp").select("run", F.col("lead").alias("ref"), "n", "p")
    # The hub has the fewest rare shingles before the meeting: of edited copies, the one that is nearest to all.
    hubs = met.groupBy("run").agg(F.min_by("ref", F.struct("p", "n", "ref")).alias("hub"))
    stars = written(inside.union(met.join(hubs, "run").select(F.col("hub").alias("a"), F.col("ref").alias("b"))).where("a <> b").distinct(), "stars")
    edges = join.links(stars, "stars")
    discard(stars)
    labels = components(edges)
    part, whole = PARTS
    near = f"{part} * greatest(n_a, n_b) <= {whole} * least(n_a, n_b) and {part + whole} * least(n_a - p_a, n_b - p_b) >= {part} * (n_a + n_b)"

    def still_open() -> DataFrame:
        """(run, m, ref, n, p, label), written: the sets of meetings, and of groups, that lie in different components yet."""
        placed = written(sets.join(labels.withColumnRenamed("node", "ref"), "ref", "left").select("ref", "grp", "n", F.coalesce("label", "ref").alias("label")), "placed")
        groups = placed.select(F.xxhash64(F.col("grp"), F.lit("group")).alias("run"), "ref", "n", F.lit(0).alias("p"), "label")
        spread = meetings.select("run", "grp", "p").join(placed, "grp").select("run", "ref", "n", "p", "label").unionByName(groups)
        mixed = spread.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("run", "m")
        out = written(spread.join(mixed, "run"), "open")
        discard(placed)
        return out

    def pairs_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        left, right = (rows.select(*keys, F.col("ref").alias(x), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}"), F.col("label").alias(f"l_{x}")) for x in "ab")
        return left.join(right, keys).where("a < b and l_a <> l_b").where(near).select("a", "b")

    # Sets of large meetings first meet a few others by chance: nearly all that can link do so here, for a few pairs each.
    for salt in range(ROUNDS):
        unplaced = still_open()
        large = unplaced.where(F.col("m") > MEET).where(F.pmod(F.xxhash64("run", F.lit(salt)), F.lit(RUN_SHARE)) == 0)
        table = F.pmod(F.xxhash64("ref", "run", F.lit(salt)), F.ceil(F.col("m") / MEET))
        more = join.links(pairs_of(large.withColumn("table", table), ["run", "table"]), f"round-{salt}")
        discard(unplaced)
        if more.isEmpty():
            break
        edges = edges.union(more)
        labels = components(edges)
    # Then every pair that met and is not connected is verified, if its places in one meeting at least leave it room to
    # link. At their first common shingle the rests of both are longest, so no pair that links is lost.
    unplaced = still_open()
    labels = components(edges.union(join.links(pairs_of(unplaced, ["run"]), "rest")))
    discard(unplaced, meetings)
    least = sets.select("ref").join(labels.withColumnRenamed("node", "ref"), "ref", "left").join(join.sets.select("ref", "rep"), "ref").select("ref", "rep", F.coalesce("label", "ref").alias("label"))
    return join, least


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the set's size and the least id reachable by links, its own included.

    Words are split at white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle of all its
    words. Null and blank texts have an empty set and link with nothing. Rows with equal texts link even under one id.
    Rows with null ids count as one id, the least of all. An empty table gives no rows.
    """
    join, least = _placed_sets(docs, id_col, text_col)
    ends = least.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_ref = least.join(ends, "label").select("ref", "component_id")
    real = lambda c: F.expr(f"nullif({c}, {NULL_ID})")
    return join.meta.join(by_ref, "ref", "left").select(
        real("doc_id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), real("coalesce(component_id, doc_id)").alias("component_id")
    )


def _with_ref(text_col: str, ref: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the hashes of their sets; null for empty sets."""
    for batch in batches:
        refs = [_hash_of(s, 1).astype(np.int64) if len(s) else None for s in shingles.sets(batch.column(text_col), SHINGLE_WORDS)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(refs, pa.int64())], [*batch.schema.names, ref])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of rows that link, directly or through others; all columns are kept.

    The row of the least id stays, whether ids are null (the least of all), repeated or neither; of several such rows
    those of the set of the least hash, and of these one with the least hash of its text. Rows without words all stay.
    """
    join, least = _placed_sets(docs, id_col, text_col)
    k, ref, apart = (fresh(docs, x) for x in ("k", "ref", "apart"))
    heads = written(least.groupBy("label").agg(F.min(F.struct("rep", "ref")).alias("head")).select(F.col("head.rep").alias(k), F.col("head.ref").alias(ref)), "heads")
    ids = join.meta.groupBy(F.col("doc_id").alias(k)).agg(F.count("*").alias("rows"), F.max("n").alias("most"))
    ids = ids.join(heads.select(k).distinct().withColumn("head", F.lit(True)), k, "left").where("rows > 1 or (most > 0 and head is null)")
    ids = written(ids.select(k, "rows"), "gone")
    rows = docs.withColumn(k, F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)))
    # Rows that go are fewer than rows that stay: texts need no shuffle while the ids that go can be broadcast.
    gone = ids.select(k)
    if ids.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    single = rows.join(gone, k, "left_anti").select(*docs.columns)
    repeated = ids.where("rows > 1").select(k)
    if repeated.isEmpty():
        return single
    # Ids on several rows: each row's own set tells whether it is the one that stays. Equal sets of an id come down to one
    # row before they are looked up, so that no id or set gathers its rows in one task.
    several = rows.join(repeated, k, "left_semi").select(*docs.columns, k)
    several = several.mapInArrow(partial(_with_ref, text_col, ref), StructType([*several.schema.fields, StructField(ref, LongType())]))
    several = several.withColumn(apart, F.when(F.col(ref).isNull(), F.monotonically_increasing_id()))
    one = several.groupBy(k, ref, apart).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias("row"))
    one = one.join(heads.withColumn("head", F.lit(True)), [k, ref], "left").where(F.col(ref).isNull() | F.col("head")).select("row.*")
    return single.unionByName(one)
