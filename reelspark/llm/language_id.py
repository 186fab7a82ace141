"""Language identification with a string kernel.

The kernel of two texts blends, over byte n-grams of lengths 1 to 4, the normalised number of n-grams that both hold
(presence, not frequency; n-grams are hashed to buckets). Nyström landmarks turn it into features, one-versus-rest
kernel ridge regression weighs them, and texts are scored by products of presence matrices with the folded weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import shingles
from reelspark.llm.shared import small_batches

#: Different rows (id and text) of each language that the model is fitted on, those of the least hashes; with many
#: languages an equal share of ALL_ROWS, one at least. No language is left out.
FIT_ROWS = 400
ALL_ROWS = 20_000
#: Landmarks of each language; with many languages an equal share of ALL_LANDMARKS, one at least.
LANDMARKS = 32
ALL_LANDMARKS = 1024
LENGTHS = (1, 2, 3, 4)
BLEND = (0.5, 1.0, 1.5, 1.5)
#: Buckets of each length.
BUCKETS = 1 << 13
RIDGE = 1e-3
#: Texts scored by one matrix product, and rows of the sample unpacked at once.
TOGETHER = 64
#: Sharpness of the score.
SHARPNESS = 6.0


def _fold() -> np.ndarray:
    """Bytes with A-Z lower-cased; all ASCII but letters is one blank."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[[b for b in range(128) if not chr(b).isalpha()]] = 32
    return table


def presence(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the buckets of its n-grams as booleans, LENGTHS one after the other."""
    fold = _fold()
    for _, data, offsets in shingles.chunks(texts):
        b = fold[data]
        grams, hashed = b.copy(), []
        for k in LENGTHS:
            if k > 1:
                grams = grams[:-1] | (b[k - 1 :] << np.uint32(8 * (k - 1)))
            hashed.append(((grams * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64))
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            out = np.zeros((len(LENGTHS), BUCKETS), bool)
            for i, k in enumerate(LENGTHS):
                if z - a >= k:
                    out[i, hashed[i][a : z - k + 1]] = True
            yield out.reshape(-1)


def normalised(p: np.ndarray) -> np.ndarray:
    """Rows whose products are the blended kernel: of a text with itself, 1."""
    x = p.reshape(len(p), len(LENGTHS), BUCKETS).astype(np.float32)
    held = np.sqrt(np.maximum(x.sum(2), 1.0)).astype(np.float32)
    x *= (np.sqrt(np.array(BLEND, np.float32) / sum(BLEND)) / held)[:, :, None]
    return x.reshape(len(p), -1)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def margins(self, p: np.ndarray) -> np.ndarray:
        return normalised(p) @ self.weights + self.bias


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([np.packbits(p).tobytes() for p in presence(batch.column("text"))], pa.binary())], ["lang", "bits"])


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(bool)


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"):
    """A broadcast Model learnt from the rows of docs with a language and a text; without any it knows no language.

    Rows of one id and text count once, so repeated rows do not fill the sample. Null ids are ids like others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h")).where("lang is not null and text is not null")
    hashes = known.groupBy("lang", "h").agg(F.count("*").alias("n"))
    count = hashes.select("lang").distinct().count()
    if not count:
        return spark.sparkContext.broadcast(Model([], np.zeros((len(LENGTHS) * BUCKETS, 0), np.float32), np.zeros(0, np.float32)))
    rows, landmarks = max(1, min(FIT_ROWS, ALL_ROWS // count)), max(1, min(LANDMARKS, ALL_LANDMARKS // count))
    # The row number keeps `rows` hashes of a language in each task before they meet.
    least = hashes.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= rows)
    chosen = known.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample = chosen.select("lang", "text").mapInArrow(_pack, "lang string, bits binary").orderBy("lang", "bits").toPandas()
    bits, y = sample["bits"].tolist(), sample["lang"].to_numpy()
    languages = sorted(set(y))
    held = np.array([int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in bits])
    # Texts of little variety tell little: landmarks are spread over each language's texts by size.
    marks = []
    for lang in languages:
        own = np.flatnonzero(y == lang)
        own = own[np.argsort(held[own], kind="stable")][::-1]
        marks += own[np.unique(np.linspace(0, len(own) - 1, landmarks).astype(int))].tolist()
    m = normalised(_unpacked([bits[i] for i in marks]))
    kernel = m @ m.T
    values, vectors = np.linalg.eigh(kernel.astype(np.float64))
    good = values > 1e-6 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    near = np.concatenate([normalised(_unpacked(bits[i : i + TOGETHER])) @ m.T for i in range(0, len(bits), TOGETHER)])
    features = near.astype(np.float64) @ to_features
    targets = np.where(y[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Languages weigh the same, whatever their share.
    _, which, size = np.unique(y.astype(str), return_inverse=True, return_counts=True)
    weight = 1 / size[which]
    weight *= len(y) / weight.sum()
    mean, goal = np.average(features, axis=0, weights=weight), np.average(targets, axis=0, weights=weight)
    f, t = features - mean, targets - goal
    solved = np.linalg.solve((f * weight[:, None]).T @ f + RIDGE * len(y) * np.eye(f.shape[1]), (f * weight[:, None]).T @ t)
    weights = m.T.astype(np.float64) @ (to_features @ solved)
    return spark.sparkContext.broadcast(Model(languages, weights.astype(np.float32), (goal - mean @ solved).astype(np.float32)))


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter; null has none."""
    out = np.zeros(len(texts), bool)
    for row, data, offsets in shingles.chunks(texts):
        ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        some = np.concatenate([[0], np.cumsum(ascii_letter)])
        high = np.concatenate([[0], np.cumsum(data >= 128)])
        for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            out[row + i] = some[z] > some[a] or (high[z] > high[a] and any(c.isalpha() for c in data[a:z].tobytes().decode("utf-8", "replace")))
    return out


def _predict(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        texts = batch.column("text")
        letters = has_letter(texts)
        lang, score, held = [], [], []

        def flush(lang=lang, score=score, held=held):
            if held and model.languages:
                e = SHARPNESS * model.margins(np.stack(held))
                e = np.exp(e - e.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                best = e.argmax(1)
                lang.extend(model.languages[b] for b in best)
                score.extend(e[np.arange(len(e)), best].astype(float).tolist())
            elif held:
                lang.extend([None] * len(held))
                score.extend([0.0] * len(held))
            held.clear()

        for p in presence(texts):
            held.append(p)
            if len(held) == TOGETHER:
                flush()
        flush()
        pred = [x if ok and x is not None else "und" for x, ok in zip(lang, letters, strict=True)]
        sure = [s if x != "und" else 0.0 for s, x in zip(score, pred, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; 'und' with score 0 for null texts, texts without a letter, or an untaught model."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_predict, model), f"doc_id {kind}, lang_pred string, score double")
