"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the rare words of a test item: all but its commonest words in the corpus, which together weigh less than half of
what an alignment must reach. An alignment that reaches it therefore holds seeds that weigh at least the other half, within as many words
as its gaps leave it. Seeds join passages to items; where those of a window weigh enough, a local alignment of the passage's
words with the item's, each weighted by its rarity in the corpus, scores the copy, edited or not. No passage is lost
that the alignment of the whole text would accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import shingles
from reelspark.llm.shared import small_batches

#: Items of fewer words count only as whole texts.
SHORT_WORDS = 3
#: Share of the weight that an alignment must reach which an item's commonest words, no seeds, may weigh together.
UNSEEDED = 0.5
#: Share of an item's weight that an alignment reaches in a contaminated document.
THRESHOLD = 0.4
#: Or what it reaches, in units of the item's mean word weight: a passage of so many words of a longer item is a copy too.
LONG_RUN = 50
#: Costs in units of the item's mean word weight.
MISMATCH, GAP = 0.6, 0.4
LEAST_WEIGHT = 0.05
#: Bytes of test items handled (and broadcast) at once; larger benchmarks are taken block by block.
BLOCK_BYTES = 4_000_000
_FILTER_BITS = 20
#: Cells of a row of alignments computed together: passages of like length, as many as fit.
ALIGN_CELLS = 40_000


def _enough(words: int) -> float:
    """The share of its weight that an alignment with an item of so many words must reach."""
    return min(THRESHOLD, LONG_RUN / words)


class _Lookup:
    """Places of hashes in a sorted table, with a bitmap that turns away most others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes into x, places in the table) of those that it has."""
        at = np.flatnonzero(self.bits[x >> np.uint64(64 - _FILTER_BITS)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        ok = self.keys[place] == x[at]
        return at[ok], place[ok]


class _Items:
    """A block of test items: their ids, words and vocabulary."""

    def __init__(self, rows: list):
        texts = pa.array([r["text"] for r in rows], pa.string())
        words = []
        for _, data, offsets in shingles.chunks(texts):
            hashes, first = shingles.word_hashes(data, offsets, plain=True)
            words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        kept = [(r["item_id"], w) for r, w in zip(rows, words, strict=True) if len(w)]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        self.vocabulary = np.unique(np.concatenate(self.words)) if kept else np.zeros(0, np.uint64)


def _span(words: int) -> int:
    """Words of text that an accepted alignment with an item of so many words can stretch over: all match, the rest of the score goes for gaps."""
    return words + int((1 - _enough(words)) * words / GAP) + 1


class _Seeds:
    """The seeds: a lookup of words, for each its (item, weight) entries; and the items' word weights, spans and needs."""

    def __init__(self, items: _Items, documents: int, counts: np.ndarray):
        self.ids, self.words = items.ids, items.words
        rarity = np.maximum(np.log((documents + 1) / (counts + 1)) / np.log(documents + 2), LEAST_WEIGHT)
        self.weights = []
        self.need, self.spans = np.zeros(len(self.ids)), np.array([_span(len(w)) for w in self.words], np.int64)
        #: Items of few words by their words.
        self.short: dict[bytes, list[int]] = {}
        entries = []
        for i, w in enumerate(self.words):
            places = np.searchsorted(items.vocabulary, w)
            self.weights.append(rarity[places])
            if len(w) < SHORT_WORDS:
                self.short.setdefault(w.tobytes(), []).append(i)
                continue
            kinds, times = np.unique(places, return_counts=True)
            kinds, times = (x[np.lexsort((kinds, rarity[kinds]))] for x in (kinds, times))
            asked = _enough(len(w)) * self.weights[i].sum()
            left_out = np.cumsum(rarity[kinds] * times) < UNSEEDED * asked
            self.need[i] = asked - (rarity[kinds] * times)[left_out].sum()
            entries += [(v, i) for v in kinds[~left_out].tolist()]
        table = np.array(sorted(entries), np.int64).reshape(-1, 2)
        seeds, first = np.unique(table[:, 0], return_index=True)
        self.lookup = _Lookup(items.vocabulary[seeds]) if len(seeds) else None
        self.first, self.items, self.rarity = np.append(first, len(table)), table[:, 1], rarity[table[:, 0]]


def _count(items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n): documents that hold a word of the items; at place -1 all documents."""
    vocabulary = items.value.vocabulary
    lookup, totals, documents = _Lookup(vocabulary), np.zeros(len(vocabulary), np.int64), 0
    for batch in batches:
        documents += batch.num_rows
        for _, data, offsets in shingles.chunks(batch.column("text")):
            words, first = shingles.word_hashes(data, offsets, plain=True)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            at, place = lookup.find(words)
            totals += np.bincount(np.unique(text[at] * len(vocabulary) + place) % len(vocabulary), minlength=len(vocabulary))
    held = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(totals[held], documents))], ["place", "n"])


def align(passages: list[np.ndarray], items: list[np.ndarray], weights: list[np.ndarray]) -> list[tuple[float, int]]:
    """Smith-Waterman: for each passage and item, the best local score over the item's weight, and the word after its end."""
    out: list = [None] * len(passages)
    order = sorted(range(len(passages)), key=lambda i: -len(passages[i]))
    a = 0
    while a < len(order):
        part = order[a : a + max(1, ALIGN_CELLS // len(passages[order[a]]))]
        a += len(part)
        ps, its, ws = ([x[i] for i in part] for x in (passages, items, weights))
        wide, deep = max(map(len, ps)), max(map(len, its))
        p, q, w = np.zeros((len(ps), wide), np.uint64), np.ones((len(ps), deep), np.uint64), np.zeros((len(ps), deep))
        for i, (x, y, z) in enumerate(zip(ps, its, ws, strict=True)):
            p[i, : len(x)], q[i, : len(y)], w[i, : len(y)] = x, y, z
        total = w.sum(1)
        mean = (total / np.array([len(y) for y in its]))[:, None]
        gaps = GAP * mean * np.arange(wide)
        row, best, end = np.zeros((len(ps), wide)), np.zeros(len(ps)), np.zeros(len(ps), int)
        for j in range(deep):
            diagonal = np.zeros_like(row)
            diagonal[:, 1:] = row[:, :-1]
            step = np.where(p == q[:, j : j + 1], w[:, j : j + 1], -MISMATCH * mean)
            row = np.maximum(np.maximum(diagonal + step, row - GAP * mean), 0)
            # Gaps along the passage: the best start to the left, less the way from there.
            row = np.maximum(row, np.maximum.accumulate(row + gaps, axis=1) - gaps)
            top = row.max(1)
            better = top > best
            end[better] = row[better].argmax(1) + 1
            best = np.maximum(best, top)
        for i, score, stop in zip(part, (best / total).tolist(), end.tolist(), strict=True):
            out[i] = (score, stop)
    return out


def _windows(seeds: _Seeds, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, item, first word, words) of the passages whose seeds, and then words, weigh enough for an alignment with an item."""
    words, first = shingles.word_hashes(data, offsets, plain=True)
    if seeds.short:
        for t in np.flatnonzero(np.diff(first) < SHORT_WORDS).tolist():
            whole = words[first[t] : first[t + 1]]
            for item in seeds.short.get(whole.tobytes(), ()):
                yield t, item, 0, whole
    if seeds.lookup is None:
        return
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, seed = seeds.lookup.find(words)
    n = seeds.first[seed + 1] - seeds.first[seed]
    entry = np.repeat(seeds.first[seed] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    at, item = np.repeat(at, n), seeds.items[entry]
    # In order of text, item and place: what the seeds up to each place weigh, as far back as an alignment reaches.
    key = text[at] * len(seeds.ids) + item
    by = np.argsort(key, kind="stable")
    key, at, item, weight = key[by], at[by], item[by], seeds.rarity[entry[by]]
    wide = len(words) + 1
    begin = np.searchsorted(key * wide + at, key * wide + np.maximum(at - seeds.spans[item], 0))
    sums = np.append(0.0, np.cumsum(weight))
    hit = np.flatnonzero(sums[1:] - sums[begin] >= seeds.need[item] - 1e-6)
    if not len(hit):
        return
    key, at, item = key[hit], at[hit], item[hit]
    span = seeds.spans[item]
    new = np.append(True, (key[1:] != key[:-1]) | (at[1:] - span[1:] > at[:-1] + span[:-1]))
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(at)) - 1
    for o, c in zip(opens.tolist(), closes.tolist(), strict=True):
        t, i = int(text[at[o]]), int(item[o])
        a, b = max(first[t], at[o] - span[o]), min(first[t + 1], at[c] + span[c])
        passage, weight = words[a:b], seeds.weights[i]
        if weight[np.isin(seeds.words[i], passage)].sum() >= _enough(len(weight)) * weight.sum() - 1e-6:
            yield t, i, int(a - first[t]), passage


def _hits(seeds: _Seeds, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end) of the contaminating passages; the first word comes from the alignment of both reversed."""
    for row, data, offsets in shingles.chunks(texts):
        found = list(_windows(seeds, data, offsets))
        scores = align([p for *_, p in found], [seeds.words[i] for _, i, *_ in found], [seeds.weights[i] for _, i, *_ in found])
        passing = [(t, item, start, p[:end], score) for (t, item, start, p), (score, end) in zip(found, scores, strict=True) if score >= _enough(len(seeds.words[item]))]
        back = align([p[::-1] for *_, p, _ in passing], [seeds.words[i][::-1] for _, i, *_ in passing], [seeds.weights[i][::-1] for _, i, *_ in passing])
        for (t, item, start, p, score), (_, length) in zip(passing, back, strict=True):
            yield row + t, item, min(score, 1.0), start + len(p) - length, start + len(p)


def _report(seeds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = seeds.value
    for batch in batches:
        best: dict[tuple[int, int], tuple] = {}
        for row, item, score, start, end in _hits(seeds, batch.column("text")):
            if score > best.get((row, item), (0.0,))[0]:
                best[row, item] = (score, start, end)
        rows = [(r, seeds.ids[i], *x) for (r, i), x in sorted(best.items())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
            ["doc_id", "item_id", "score", "first_word", "end_word"],
        )


def _clean(seeds, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = seeds.value
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for row, *_ in _hits(seeds, batch.column(text_col)):
            keep[row] = False
        yield batch.filter(pa.array(keep))


def _blocks(docs: DataFrame, text_col: str, items: DataFrame) -> Iterator:
    """Seeds of the benchmark, block by block: their counts over all documents are taken here, their use is lazy."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna(subset=["text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        block = _Items(sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"])))
        if not block.ids:
            continue
        shared = context.broadcast(block)
        counted = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_count, shared), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
        counts, documents = np.zeros(len(block.vocabulary), np.int64), 0
        for place, n_docs in counted:
            if place < 0:
                documents = n_docs
            else:
                counts[place] = n_docs
        yield context.broadcast(_Seeds(block, documents, counts))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): each document's best passage for every item that it holds.

    The alignment begins at first_word of the text and ends before end_word (words from 0); of equal ones the first counts.
    items has item_id and text; a null item_id is reported as it is, repeated items once. score is the alignment's share
    of the item's weight, 1 at most: THRESHOLD at least, or for items of more than LONG_RUN / THRESHOLD words LONG_RUN
    mean word weights. Items of fewer than SHORT_WORDS words count only where they are the whole text. Words are runs
    of ASCII letters, digits and other characters beyond ASCII; A-Z are lower-cased. Null texts, texts and items without
    words give nothing; repeated rows give their results each; an empty table on either side gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for seeds in _blocks(docs, "text", items):
        out = out.union(docs.mapInArrow(partial(_report, seeds), schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a contaminating passage, with all their columns."""
    out = docs
    for seeds in _blocks(docs, text_col, items):
        out = out.mapInArrow(partial(_clean, seeds, text_col), docs.schema)
    return out
