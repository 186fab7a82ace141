"""Chat formatting, the Jaccard join, decontamination, the classifiers and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelspark.llm import chat, components, decontaminate, jaccard_join, language_id, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "ti", "ve") for c in ("", "r", "st", "ld", "x")]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


# -- chat

def test_escaping_is_reversible(spark):
    rng = random.Random(1)
    pieces = ["<", "[", "/", "s>", "INST]", "/INST]", "<s>", "</s>", "<<SYS>>", "<|im_end|>", "<|im_start|>user\n", "⁠", "a\n", "$1", "\\", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t
        assert not re.search(r"[<\[](?:/?s>|/?INST\]|</?SYS>>|\|\w+\|>)", r.e)


def test_conversations_read_back(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a<|im_end|>\n<|im_start|>x"), (1, 3, "tool\nx y", None), (1, 4, "assistant", "ü"), (2, 1, None, "alone"), (None, 1, "user", "t"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    turns = spark.createDataFrame(rows, "tree bigint, turn bigint, role string, text string")
    out = chat.format_paths(chat.paths(chat.chain(turns)))
    got = {r.tree: r for r in out.select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a<|im_end|>\n<|im_start|>x"), ("assistant", "b</s>"), ("tool\nx y", ""), ("assistant", "ü")]
    assert got[1].loss == "b</s>ü" and got[2].loss == ""
    assert len(got[3].turns) == 2 and None in got
    assert chat.format_paths(chat.paths(chat.chain(turns.limit(0)))).count() == 0


def test_paths_of_a_tree_are_ranked(spark):
    rng = random.Random(4)
    parent = {0: None} | {i: rng.randrange(max(0, i - 3), i) for i in range(1, 60)}
    score = {i: rng.random() for i in parent}
    rows = [("t", i, p, "user" if i % 2 else "assistant", f"m{i}", score[i]) for i, p in parent.items()]
    rows += [("loop", 1, 2, "user", "x", 1.0), ("loop", 2, 3, "user", "x", 1.0), ("loop", 3, 1, "user", "x", 1.0), ("loop", 4, 1, "user", "x", 1.0), ("orphan", 5, 99, "user", "o", None)]
    got = chat.paths(spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double"), None).collect()
    want = {}
    for leaf in set(parent) - set(parent.values()):
        path, n = [], leaf
        while n is not None:
            path.append(n)
            n = parent[n]
        want[leaf] = path[::-1]
    rank = {leaf: k for k, leaf in enumerate(sorted(want, key=lambda x: (-np.mean([score[n] for n in want[x]]), x)), 1)}
    by_leaf = {}
    for r in got:
        if r.tree == "t":
            by_leaf.setdefault(r.leaf, {})[r.depth] = r.text
            assert r.path_rank == rank[r.leaf]
    assert {k: [v[i] for i in range(len(v))] for k, v in by_leaf.items()} == {k: [f"m{n}" for n in p] for k, p in want.items()}
    assert {r.tree for r in got} == {"t", "orphan"}


# -- near copies

def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    group = {}
    for i, x in enumerate(least):
        group[x] = min(group.get(x, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), group[x]) for i, x in enumerate(least))


def corpus(rng, n=150):
    texts = [None, "", " \n\t", "one", "One", "one two three", "a b c d", "a b c d e"]
    shared = words(rng, 40)
    while len(texts) < n:
        w = words(rng, rng.choice([6, 20, 60, 200]))
        if rng.random() < 0.4:
            w[rng.randrange(len(w)) :] = shared + words(rng, 30)
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            v = list(w)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n"]).join(v))
    return texts


@pytest.mark.parametrize("seed,wide", [(1, 32), (2, 3), (3, 2)])
def test_links_equal_brute_force(spark, monkeypatch, seed, wide):
    monkeypatch.setattr(jaccard_join, "WIDE_FROM", wide)
    rng = random.Random(seed)
    rows = list(enumerate(corpus(rng)))
    rng.shuffle(rows)
    rows += rows[:3] + [(rows[5][0], "another text under the same id")]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("seed,wide", [(4, 8), (5, 1000)])
def test_a_passage_in_very_many_texts(spark, monkeypatch, seed, wide):
    """Texts around one passage, of which some link by it and most just do not."""
    monkeypatch.setattr(jaccard_join, "WIDE_FROM", wide)
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 25)) + passage + words(rng, rng.randrange(0, 25)))) for i in range(220)]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    want = brute(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert 20 < len({c for _, _, c in want}) < 215


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(corpus(rng, 80))]
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows + rows[3:5], SCHEMA).withColumn("k", F.lit(1))).collect())
    assert kept == sorted(d for d, _, c in brute([r[:2] for r in rows]) if d == c)
    assert jaccard_join.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays_under_null_and_repeated_ids(spark):
    rng = random.Random(11)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    text = lambda w, *end: " ".join([*w, *end])
    rows = [(None, text(a)), (None, text(a, "x")), (None, text(a).upper()), (None, text(a).replace(" ", "\n")), (None, text(b)), (1, text(b, "y"))]
    rows += [(2, text(c)), (3, text(c, "z")), (3, text(d)), (3, text(d, "x")), (3, text(d)), (4, text(e)), (4, text(e).upper()), (5, text(e, "x"))]
    blank = [(None, None), (None, None), (None, " "), (3, ""), (3, ""), (6, None)]
    want = [(None, a), (None, b), (2, c), (3, d), (4, e)]
    for seed in range(2):
        data = [(i, t, "en", "s", 0) for i, t in rows + blank]
        random.Random(seed).shuffle(data)
        kept = [(r.doc_id, (r.text or "").lower().split()) for r in jaccard_join.keep_one(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()]
        assert sorted(i or 0 for i, w in kept if not w) == [0, 0, 0, 3, 3, 6]
        assert sorted((i or 0, w[:60]) for i, w in kept if w) == sorted((i or 0, w) for i, w in want)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


# -- decontamination

def smith_waterman(p, q, w):
    mean = sum(w) / len(w)
    h = np.zeros((len(q) + 1, len(p) + 1))
    for j in range(1, len(q) + 1):
        for i in range(1, len(p) + 1):
            h[j, i] = max(0, h[j - 1, i - 1] + (w[j - 1] if p[i - 1] == q[j - 1] else -decontaminate.MISMATCH * mean), h[j - 1, i] - decontaminate.GAP * mean, h[j, i - 1] - decontaminate.GAP * mean)
    return h.max() / sum(w)


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(1)
    ps = [rng.integers(2, 9, rng.integers(1, 30)).astype(np.uint64) for _ in range(40)]
    qs = [rng.integers(2, 9, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    ws = [rng.random(len(q)) + 0.1 for q in qs]
    got = decontaminate.align(ps, qs, ws)
    assert np.allclose([s for s, _ in got], [smith_waterman(p, q, w) for p, q, w in zip(ps, qs, ws, strict=True)])


def test_copies_and_edits_are_found_and_clean_texts_left(spark, monkeypatch):
    rng = random.Random(6)
    items = [words(rng, rng.randrange(12, 50)) for _ in range(20)]
    rows, leaks = [], {}
    for i in range(200):
        w = words(rng, rng.randrange(30, 300))
        if i % 4 == 0:
            k = rng.randrange(20)
            v = list(items[k])
            for _ in range(len(v) // 8 * (i % 3)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            at = rng.randrange(len(w))
            w[at:at] = v
            leaks[i] = k
        rows.append((i, " ".join(w).capitalize() + ".", "en", "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "!!", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in enumerate(items)] + [(50, None), (51, ""), (52, "two words")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == set(leaks.items())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == got
    kept = decontaminate.drop_contaminated(docs.withColumn("item_id", F.lit(1)), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in leaks)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_items_without_an_id_and_runs_of_long_items_are_found(spark):
    rng = random.Random(12)
    unnamed, long = words(rng, 25), words(rng, 500)
    rows = [(0, words(rng, 40) + unnamed + words(rng, 40)), (1, words(rng, 90) + long[150:340] + words(rng, 90)), (2, long[10:80]), (3, words(rng, 50) + long[30:50] + words(rng, 50))]
    rows += [(i, words(rng, 200)) for i in range(4, 40)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in rows], SCHEMA)
    bench = spark.createDataFrame([(None, " ".join(unnamed)), (1, " ".join(long)), (None, None), (2, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(0, None), (1, 1), (2, 1)} and got[1, 1] < decontaminate.THRESHOLD
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == list(range(3, 40))


# -- classifiers

def test_segments_are_the_maximal_ones():
    def slow(s):
        """The best segment, the shortest of equals, then the same on both sides of it."""
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = best[3:]
        return slow(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, z) for x, y, z in slow(s[b:])]

    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 25))
        got, want = toxicity.segments(s), slow(s.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(8)
    bad = ["vilo", "grax", "mudd", "snek"]
    rows, labels = [], []
    for i in range(900):
        w, toxic = words(rng, rng.randrange(5, 120)), i % 5 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        toxic = any(x in bad for x in w)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labs = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labs.where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, _, t in labels[600:] if (got[i].score >= 0.5) != bool(t)]
    assert len(got) == len(rows) and len(wrong) <= 6
    assert got[5000].score == got[5001].score < 0.5 and not got[5000].passages
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.5}
    blank = toxicity.fit(docs, labs.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, blank).collect())


def test_languages_on_held_out_texts(spark):
    rng = random.Random(9)
    tongues = {"aa": ["the", "house", "with"], "bb": ["der", "würde", "mit"], "cc": ["qué", "año", "con"]}
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randrange(3, 40))), k, "s", 0) for i in range(300) for k, v in [rng.choice(sorted(tongues.items()))]]
    rows += [(900, None, "aa", "s", 0), (901, "12 !", "aa", "s", 0), (902, "", None, "s", 0), (903, "é", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs.where("doc_id < 200"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows[200:300])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in tongues
    assert all(0 <= r.score <= 1 for r in got.values())
    untaught = language_id.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(docs, untaught).collect()} == {"und"}


# -- the pipeline

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(10)
    bad = ["vilo", "grax", "mudd", "snek"]
    item = words(rng, 30)
    rows, labels, toxic_ids, leak_ids = [], [], set(), set()
    for i in range(400):
        w = words(rng, rng.randrange(30, 90))
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
            toxic_ids.add(i)
        elif i % 37 == 1:
            w[5:5] = item
            leak_ids.add(i)
        labels.append((i, 0, int(i in toxic_ids)))
        rows.append([i, " ".join(w), "en", f"src{i % 4}", 0])
    rows += [[1000 + i, rows[i][1], "en", "src0", 0] for i in (2, 3, 4)]
    rows[2][1] = rows[-3][1] = rows[2][1] + ' token = "Zq81xPlm0Aa77"'
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, " ".join(item))], "item_id bigint, text string")):
        spark.createDataFrame([tuple(r) for r in data], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} - toxic_ids - leak_ids - {1002, 1003, 1004}
    assert got[2].text.endswith(" [assign]\"") and got[2].n_chars == len(got[2].text)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram jaccard join", "benchmark decontamination", "secret scans", "source mixing"]


def test_languages_of_repeated_ids_ties_and_empty_tables(spark):
    text = F.concat(F.lit("hello world "), F.col("id") % 5)
    same = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"), F.lit(1).alias("h"), F.lit("x").alias("score"))
    other = spark.createDataFrame([(None, "fr", "bonjour le monde", 0, ""), (3, "fr", None, 0, ""), (4, None, "no", 0, "")], "doc_id int, lang string, text string, h int, score string")
    model = language_id.fit(same.unionByName(other))
    assert model.value.languages == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score > 0.5) for r in language_id.predict(other, model).collect()}
    assert got[None] == ("fr", True) and got[3] == ("und", False)
    assert {r.lang_pred for r in language_id.predict(same.limit(9), model).collect()} == {"en"}
    nothing = language_id.fit(same.limit(0))
    assert [tuple(r) for r in language_id.predict(same.limit(1), nothing).collect()] == [(7, "und", 0.0)]
    assert language_id.predict(same.limit(0), model).count() == 0


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ALL_ROWS", 100)
    monkeypatch.setattr(language_id, "ALL_LANDMARKS", 60)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.format_string("l%02d", F.col("id") % 40).alias("lang"), F.repeat(F.format_string("%s%s ", F.chr(97 + F.col("id") % 20), F.chr(65 + F.col("id") % 40 % 23)), 9).alias("text"))
    model = language_id.fit(docs)
    assert len(model.value.languages) == 40
    out = language_id.predict(docs, model).join(docs, "doc_id")
    assert out.where("lang_pred = lang").count() > 550


def test_short_items_and_places_of_passages(spark):
    rng = random.Random(4)
    item = " ".join(words(rng, 40))
    docs = spark.createDataFrame(
        [(1, "yes"), (2, "oh yes it is"), (3, "Yes!"), (4, "zz " * 30 + item + " yy" * 30), (4, "zz " * 30 + item + " yy" * 30), (5, None), (6, "qq " * 50_000 + item)], "doc_id bigint, text string"
    )
    items = spark.createDataFrame([(1, "yes"), (2, item), (2, item), (3, "")], "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, items).select("doc_id", "item_id", "first_word", "end_word", F.round("score", 6)).collect())
    assert got == [(1, 1, 0, 1, 1.0), (3, 1, 0, 1, 1.0), (4, 2, 30, 70, 1.0), (4, 2, 30, 70, 1.0), (6, 2, 50_000, 50_040, 1.0)]
    assert decontaminate.contaminated(docs, items).where("score > 1").isEmpty()
    assert decontaminate.contaminated(docs.limit(0), items).isEmpty() and decontaminate.contaminated(docs, items.limit(0)).isEmpty()
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [2, 5]


def test_paths_under_a_cycle_and_of_a_long_chain(spark):
    chain = [("t", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)]
    loop = [(None, 1, 2, "user", "x", 0.0), (None, 2, 1, "user", "y", 0.0), (None, 3, 1, "user", "z", 0.0)]
    df = spark.createDataFrame(chain + loop, "tree string, node bigint, parent bigint, role string, text string, score double")
    got = chat.paths(df, None).orderBy("depth").collect()
    assert [r.text for r in got] == [str(i) for i in range(300)] and {r.leaf for r in got} == {299}
    assert chat.paths(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_links_with_hot_shingles_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "WIDE_FROM", 3)
    monkeypatch.setattr(jaccard_join, "HOT_FROM", 5)
    rows = list(enumerate(corpus(random.Random(seed), 120)))
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(9)
    bad = ["grubble", "snorkity", "vexhole"]
    rows = [(i, " ".join(words(rng, 60) + (bad * 9 if i % 4 == 0 else []))) for i in range(240)]
    docs = spark.createDataFrame([*rows, *rows[:40], (900, None), (901, ""), (902, " ".join(words(rng, 30_000) + bad * 30)), (None, "x")], "doc_id bigint, text string")
    docs = docs.withColumn("toxic", F.lit("clash")).withColumn("k", F.lit(1))
    # Of labels of one id that differ the toxic one counts; null ids and labels teach nothing.
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(0, 0), (1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 284 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 240)
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 900}
    assert odd[900].score == odd[901].score < 0.5 and odd[902].score >= 0.5 and odd[902].passages[-1].first_word >= 29_000
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0 and doc_id < 240").isEmpty()
    for none in (toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.limit(0))):
        assert {r.score >= 0.5 for r in toxicity.score(docs.limit(9), none).collect()} == {False}
    assert toxicity.score(docs.limit(0), model).isEmpty()


def pipeline_tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_pipeline_of_odd_tables(spark, tmp_path):
    rng = random.Random(10)
    said = [" ".join(words(rng, 80)) for _ in range(12)]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(said)]
    docs += [docs[3], docs[3], (20, said[4] + " more", "en", None, None), (21, None, None, None, None), (22, "", "en", "src0", 0), (None, said[5], "en", "src1", 1), (23, said[6] + " token=Zq81kkLmw02x", "en", "src9", 9)]
    out = pipeline_tables(spark, tmp_path / "a", docs, [], [(1, said[7])]).collect()
    kept = [r.doc_id for r in out]
    # One of each group: null ids are the least; repeated rows are one; texts without words stay; the benchmark's goes.
    assert sorted(k for k in kept if k is not None) == [0, 1, 2, 3, 4, 6, 8, 9, 10, 11, 21, 22] and kept.count(None) == 1
    assert len({(r.stream, r.slot, r.place_in_block) for r in out}) == len(out)
    assert pipeline_tables(spark, tmp_path / "b", [], [(1, 0, 1)], [(1, "x y z")]).isEmpty()
    toxic = [(i, " ".join(words(rng, 80)) + " grubble snorkity vexhole" * 9 * (i < 100), "en", "s", 1) for i in [*range(60), *range(100, 160)]]
    out = pipeline_tables(spark, tmp_path / "c", toxic, [(r[0], 1, int(r[0] < 100)) for r in toxic], [])
    assert sorted(r.doc_id for r in out.collect()) == list(range(100, 160))
    assert pipeline_tables(spark, tmp_path / "d", toxic[:60] * 2, [(r[0], 1, 1) for r in toxic[:60]], []).where("doc_id is null").isEmpty()


def test_an_edited_crowd_below_the_likeness_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 150)
    def edited(k):
        w = list(base)
        for j in rng.sample(range(150), k):
            w[j] = f"own{rng.random()}"
        return " ".join(w)
    texts = [edited(rng.randrange(0, 25)) for _ in range(400)]
    made = []
    links = jaccard_join._Join.links
    monkeypatch.setattr(jaccard_join._Join, "links", lambda self, pairs, label: (made.append(pairs.count()), links(self, pairs, label))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link(df).collect()}
    assert got == {i: c for i, _, c in brute(list(enumerate(texts)))}
    assert sum(made) < 4000


def plain_toxicity(docs, labels):
    """The whole of scoring in plain Python: {id: (score, [(first word, end word)])} of texts without near copies."""
    said = {i: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) for i, t in docs}
    taught = {i: y for i, y in labels if i in said}
    t, c = ({w: sum(w in set(said[i]) for i in taught if taught[i] == y) for w in {w for i in taught for w in said[i]}} for y in (1, 0))
    n_t, n_c = sum(t.values()), sum(c.values())
    weight, scores, shares = (n_t + n_c) * toxicity.PRIOR, {}, {}
    for w in t:
        p = (t[w] + c[w]) * toxicity.PRIOR
        delta = np.log((t[w] + p) / (n_t + weight - t[w] - p)) - np.log((c[w] + p) / (n_c + weight - c[w] - p))
        if abs(delta) / np.sqrt(1 / (t[w] + p) + 1 / (c[w] + p)) >= toxicity.SURE:
            scores[w], shares[w] = delta, (c[w] + p) / (n_c + weight)

    def slow(s):
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0, 0))
        a, b = best[3:]
        return [] if best[0] <= 0 else slow(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, z) for x, y, z in slow(s[b:])]

    excess = lambda x: (1 - sum(shares.values())) * np.exp(-x * toxicity.DRIFT) + sum(p * np.exp(x * (scores[w] - toxicity.DRIFT)) for w, p in shares.items()) - 1
    lam = next((x for x in np.linspace(1e-3, 3, 300_000) if excess(x) >= 0), 3.0)
    found = {i: slow([scores.get(w, 0.0) - toxicity.DRIFT for w in ws]) for i, ws in said.items()}
    clean = [i for i in taught if not taught[i] and said[i]]
    all_scores = [s for i in clean for *_, s in found[i]]
    at = np.median(all_scores) if all_scores else 1.0
    log_k = np.log(max(sum(s >= at for s in all_scores), 0.5) / sum(len(said[i]) for i in clean)) + lam * at
    level = -np.log(toxicity.SIGNIFICANT)
    bits = {i: [lam * s - log_k - np.log(max(len(said[i]), 1)) for *_, s in found[i]] for i in said}
    evidence = {i: sum(x for x in b if x >= level) or min(max([*b, 0.0]), level) for i, b in bits.items()}
    slope, middle = toxicity._calibrate(np.array([evidence[i] for i in taught]), np.array([taught[i] == 1 for i in taught]))
    return {i: (1 / (1 + np.exp(-np.clip(slope * (evidence[i] - middle), -50, 50))), [f[:2] for f, x in zip(found[i], bits[i], strict=True) if x >= level]) for i in said}


def test_toxicity_equals_the_plain_computation(spark):
    rng = random.Random(14)
    bad = ["vilo", "grax", "mudd", "snek"]
    docs, labels = [(500, None), (501, ""), (502, "Vilo GRAX, mudd-snek!")], []
    for i in range(160):
        w = words(rng, rng.randrange(8, 45))
        for _ in range(rng.choice([1, 3]) if i % 4 == 0 else 0):
            w[rng.randrange(len(w)) :] = rng.sample(bad, 2) + w[-3:]
        docs.append((i, " ".join(w)))
        labels.append((i, int(any(x in bad for x in w))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels[:110], "doc_id bigint, toxic int"))
    want = plain_toxicity(docs, labels[:110])
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert set(got) == set(want) and sum(s >= 0.5 for s, _ in want.values()) > 20
    for i, (score, spans) in want.items():
        assert abs(got[i].score - score) < 1e-3 and [(p.first_word, p.end_word) for p in got[i].passages] == spans


def test_copies_and_other_texts_of_an_id_teach_nothing(spark):
    rng = random.Random(15)
    apart, a = [words(rng, 40 + i) for i in range(30)], words(rng, 80)
    texts = [*apart, a, a, [w.upper() for w in a], a[:2], [], []]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(3, "another text")] * 5 + [(99, None)], "k bigint, text string").dropna()
    labels = spark.createDataFrame([(i, i % 2) for i in range(36)] + [(99, 1), (None, 1), (7, None)], "k bigint, toxic int")
    taught = [r.text for r in toxicity._lessons(docs, labels, 1000).collect()]
    # Of the copies that of the least id stays, also of texts without words; of id 3 one text.
    assert len(taught) == 33 and {" ".join(a), " ".join(a[:2]), ""} <= set(taught)
    assert toxicity._lessons(docs, labels, 10).count() <= 10
