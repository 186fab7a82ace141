"""Toxic passages by maximum-scoring segments.

Tokens are scored by their log-odds between toxic and other labelled texts, under Dirichlet priors in proportion to the
tokens' frequency in both, near copies left out. One linear scan of a text finds all maximal segments; the extreme-value law of
such segments in clean text gives each its expected number, and what the significant ones sum up to is calibrated on labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import shingles
from reelspark.llm.shared import small_batches, written

#: The model is fitted on the texts of at most this many labelled ids, chosen by a hash of the ids; one text of each id.
#: It bounds the ids (8 bytes each) that join the texts by broadcast.
FIT_ROWS = 24_000
#: Tokens of the model at most: those with the most extreme log-odds.
MODEL_TOKENS = 200_000
#: Weight of the prior in either class, as a share of all tokens counted.
PRIOR = 0.1
#: Standard errors by which a token's log-odds differ from 0 before they count.
SURE = 2.0
#: Taken from every token's score, so that clean text scores below 0 on average.
DRIFT = 0.25
#: Expected number in clean text below which a segment is significant.
SIGNIFICANT = 0.01


class Model:
    """Token scores, the law of the best segments, and the calibration."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.scores = hashes[by], scores[by]
        self.lam, self.log_k, self.slope, self.middle = 1.0, 0.0, 1.0, 1.0

    def token_scores(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -DRIFT)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            hit = self.hashes[at] == words
            out[hit] += self.scores[at[hit]]
        return out

    def bits(self, score: float, length: int) -> float:
        """- log of the number of segments of this score expected in a clean text of this length."""
        return self.lam * score - self.log_k - np.log(max(length, 1))

    def evidence(self, segments: list[tuple[int, int, float]], length: int) -> float:
        """The significant segments' sum of bits; else the best segment's, at most the significance level."""
        if not segments:
            return 0.0
        bits = np.array([self.bits(s, length) for *_, s in segments])
        good = bits[bits >= -np.log(SIGNIFICANT)]
        return float(good.sum()) if len(good) else float(np.clip(bits.max(), 0.0, -np.log(SIGNIFICANT)))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.middle), -50, 50))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in order, in linear time (Ruzzo and Tompa's method)."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # Neighbouring positives join at once; what is left are candidate segments with the sums before and after them.
    breaks = np.flatnonzero(np.diff(up) > 1)
    first, last = up[np.append(0, breaks + 1)], up[np.append(breaks, len(up) - 1)] + 1
    kept: list[list] = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        item = [a, b, total[a], total[b], -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= item[2]:
                j = kept[j][4]
            item[4] = j
            if j < 0 or kept[j][3] >= item[3]:
                kept.append(item)
                break
            item = [kept[j][0], item[1], kept[j][2], item[3], -1]
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, t, c): in how many toxic and clean texts each token stands."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
        for row, data, offsets in shingles.chunks(batch.column("text")):
            words, first = shingles.word_hashes(data, offsets, plain=True)
            held = [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            bad = np.repeat(toxic[row : row + len(held)], [len(h) for h in held])
            tokens, place = np.unique(np.concatenate(held), return_inverse=True)
            t = np.bincount(place[bad], minlength=len(tokens))
            c = np.bincount(place[~bad], minlength=len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["token", "t", "c"])


def _each(model: Model, texts: pa.Array) -> Iterator[tuple[int, list, int]]:
    """(row, segments, words) of each text."""
    for row, data, offsets in shingles.chunks(texts):
        words, first = shingles.word_hashes(data, offsets, plain=True)
        scores = model.token_scores(words)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            yield row + i, segments(scores[a:b]), int(b - a)


def _best(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, length, scores) of the fitting rows: the scores of all their segments."""
    for batch in batches:
        found = [(length, [s for *_, s in segs]) for _, segs, length in _each(model.value, batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.float64()))], ["toxic", "length", "scores"]
        )


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        out, spans = [], []
        for _, segs, length in _each(model, batch.column("text")):
            out.append(model.probability(model.evidence(segs, length)))
            spans.append([{"first_word": a, "end_word": b, "bits": float(model.bits(s, length))} for a, b, s in segs if model.bits(s, length) >= -np.log(SIGNIFICANT)])
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("bits", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])


def _keep(model, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        yield batch.filter(pa.array([model.probability(model.evidence(segs, length)) < 0.5 for _, segs, length in _each(model, batch.column(text_col))], pa.bool_()))


def _decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The lambda of Karlin and Altschul: the positive root of sum p exp(lambda s) = 1 over clean text's tokens."""
    excess = lambda x: (1 - shares.sum()) * np.exp(-x * DRIFT) + (shares * np.exp(x * (scores - DRIFT))).sum() - 1
    lo, hi = 1e-3, 3.0
    if excess(hi) < 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def _density(scores: np.ndarray, words: int, lam: float) -> float:
    """log K, from the number of segments in clean texts that reach their median score; half a segment where there are none."""
    at = float(np.median(scores)) if len(scores) else 1.0
    return float(np.log(max((scores >= at).sum(), 0.5) / max(words, 1)) + lam * at)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of batches and three min-hashes of each text's shingles, which near copies mostly share."""
    salts = np.random.default_rng(3).integers(1, 1 << 63, 3, dtype=np.uint64)
    for batch in batches:
        keys = [[int(shingles.mixed(s ^ salt).min() >> np.uint64(1)) if len(s) else -1 for salt in salts] for s in shingles.sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])


def _lessons(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): one text of each chosen id, the one of the least hash, without texts that share a min-hash with that of a lesser id.

    These are near copies and, less surely, texts around one passage: whatever else a copied text says would look toxic.
    """
    known = labels.dropna().groupBy("k").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(rows)
    one = docs.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    sample = written(one.mapInArrow(_keys, "k bigint, text string, toxic int, keys array<bigint>"), "toxicity-sample")
    keyed = sample.select("k", F.posexplode("keys").alias("place", "key"))
    shared = keyed.select("k", F.min("k").over(Window.partitionBy("place", "key")).alias("least")).where("least < k").select("k").distinct()
    # At most as many ids as were chosen.
    return sample.join(F.broadcast(shared), "k", "left_anti").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS):
    """A broadcast Model learnt from labels (id, toxic).

    Rows with null ids, labels or texts teach nothing; of different labels of one id the toxic one counts, of different texts
    the one of the least hash. Without any labelled text the model gives every text the score of a clean one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    said = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("text")).dropna(subset=["text"])
    texts = _lessons(said, labels.select(F.col(id_col).cast("bigint").alias("k"), F.col("toxic").cast("int").alias("toxic")), rows)
    counts = written(texts.mapInArrow(_token_counts, "token bigint, t bigint, c bigint").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-tokens")
    sums = counts.agg(F.sum("t"), F.sum("c")).first()
    n_t, n_c = int(sums[0] or 0), int(sums[1] or 0)
    if not n_t or not n_c:
        return spark.sparkContext.broadcast(Model(np.zeros(0, np.uint64), np.zeros(0)))
    prior, weight = (F.col("t") + F.col("c")) * PRIOR, (n_t + n_c) * PRIOR
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + weight) - F.col(y) - prior))
    delta = odds("t", n_t) - odds("c", n_c)
    error = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    # Only tokens that a label favours beyond doubt have a score of their own; all others have the drift alone.
    share = (F.col("c") + prior) / (n_c + weight)
    scored = counts.select("token", delta.alias("delta"), (delta / error).alias("z"), share.alias("share")).where(F.abs("z") >= SURE)
    table = scored.orderBy(F.desc(F.abs("z")), "token").limit(MODEL_TOKENS).toPandas()
    model = Model(table["token"].to_numpy(np.int64).view(np.uint64), table["delta"].to_numpy(np.float64))
    first = spark.sparkContext.broadcast(model)
    seen = texts.mapInArrow(partial(_best, first), "toxic int, length bigint, scores array<double>").toPandas()
    length, toxic = seen["length"].to_numpy(np.int64), seen["toxic"].to_numpy() == 1
    clean = ~toxic & (length > 0)
    model.lam = _decay(model.scores, table["share"].to_numpy(np.float64)[np.argsort(table["token"].to_numpy(np.int64).view(np.uint64))])
    model.log_k = _density(np.concatenate([np.zeros(0), *(np.asarray(x) for x in seen["scores"][clean])]), int(length[clean].sum()), model.lam)
    evidence = np.array([model.evidence([(0, 0, x) for x in s], n) for s, n in zip(seen["scores"], length, strict=True)])
    model.slope, model.middle = _calibrate(evidence, toxic)
    return spark.sparkContext.broadcast(model)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, middle) of a logistic curve: the middle parts the labels with the fewest errors, the slope fits around it.

    The middle is at least the significance level: a text without a significant passage is never called toxic.
    """
    by = np.argsort(x, kind="stable")
    xs, ys = x[by], y[by]
    below, above = np.append(0, np.cumsum(ys)), np.append(np.cumsum((~ys)[::-1])[::-1], 0)
    errors = (below + above).astype(float)
    errors[1:-1][xs[1:] == xs[:-1]] = np.inf
    least = np.flatnonzero(errors == errors.min())
    cut = int(least[len(least) // 2])
    lo = xs[cut - 1] if cut else xs[0] - 1
    hi = xs[cut] if cut < len(xs) else xs[-1] + 1
    middle = max(float((lo + hi) / 2), float(-np.log(SIGNIFICANT)))
    slopes = np.geomspace(0.05, 5, 25)
    z = np.clip(np.outer(slopes, x - middle), -50, 50)
    loss = np.where(y, np.log1p(np.exp(-z)), np.log1p(np.exp(z))).sum(1)
    return float(slopes[int(loss.argmin())]), middle


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages): how likely each text is toxic, and its significant passages in words from 0.

    Null and empty texts have no passages and the least score; every row is kept, repeated ones too.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_score, model), f"doc_id {kind}, score double, passages array<struct<first_word:bigint,end_word:bigint,bits:double>>")


def drop_toxic(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    return docs.mapInArrow(partial(_keep, model, text_col), docs.schema)
