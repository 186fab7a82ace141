"""Whole queries without SQL of their own: language ID against a plain computation, the exact columns of fingerprints against SQL."""

import random
import zlib

import duckdb
import numpy as np

from reelspark.llm import language_id, queries

TABLES = "/root/testdata/sf0.001"


def grams(text):
    """For each length, the set of a text's buckets."""
    b = [c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c for c in text.encode()]
    whole = lambda i, k: sum(b[i + j] << 8 * j for j in range(k))
    return [{(whole(i, k) * 2654435761 & 0xFFFFFFFF) >> 19 for i in range(len(b) - k + 1)} for k in language_id.LENGTHS]


def kernel(x, y):
    return sum(w * len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for w, a, b in zip(language_id.BLEND, x, y, strict=True)) / sum(language_id.BLEND)


def plain_languages(learnt, texts):
    """Kernel ridge regression on all learnt (text, lang), each language of equal weight: [(lang, score)] of texts."""
    sets, names = [grams(t) for t, _ in learnt], sorted({g for _, g in learnt})
    root = np.linalg.cholesky(np.array([[kernel(a, b) for b in sets] for a in sets]))
    target = np.array([[1.0 if g == n else -1.0 for n in names] for _, g in learnt])
    weight = np.array([1 / sum(g == other for _, other in learnt) for _, g in learnt])
    weight *= len(learnt) / weight.sum()
    mean, goal = (weight @ root) / weight.sum(), (weight @ target) / weight.sum()
    f, w = root - mean, np.diag(weight)
    beta = np.linalg.solve(f.T @ w @ f + language_id.RIDGE * len(learnt) * np.eye(len(learnt)), f.T @ w @ (target - goal))
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        own = grams(t)
        e = np.exp(language_id.SHARPNESS * ((np.linalg.solve(root, [kernel(own, s) for s in sets]) - mean) @ beta + goal))
        out.append((names[int(e.argmax())], float(e.max() / e.sum())))
    return out


def test_language_query_equals_the_plain_computation(spark, tmp_path):
    rng = random.Random(17)
    letters = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklméü王 "}
    said = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n)) + rng.choice(["", "!", " 12", " A"])
    rows = [(i, said(g, rng.randrange(5, 120)), g) for i, g in enumerate(rng.choices(list(letters), [3, 2, 1], k=80))]
    rows += [(90, None, "aa"), (91, "123 !", None), (93, said("bb", 5000), None), (94, said("cc", 40), None), (95, "é", None), (96, "zzz", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    learnt = [(t, g) for i, t, g in rows if not held[i] and t is not None and g is not None]
    assert max(sum(g == k for _, g in learnt) for k in letters) <= language_id.LANDMARKS
    got = {r.doc_id: r for r in queries.op7_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (lang, score) in zip(rows, plain_languages(learnt, [t for _, t, _ in rows]), strict=True):
        assert (got[i].held_out, got[i].lang_pred) == (held[i], lang), i
        assert abs(got[i].score - score) < 5e-3, (i, got[i].score, score)


def test_exact_columns_of_fingerprints_equal_sql(spark):
    want = duckdb.sql(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{TABLES}/documents.parquet'),
    n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
    SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(following, 1, length(t) // 4)) AS edited_sha256 FROM n""").fetchall()
    got = queries.op2_document_fingerprints(spark, TABLES).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
