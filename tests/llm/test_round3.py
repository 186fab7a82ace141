"""Merkle manifest, conversation repair and token files against brute force, with edge cases."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reelspark.llm import conversation_repair, decontaminate, jaccard_join, merkle_manifest, mixing, pii, queries, token_files

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# -- Merkle manifest

def said(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def brute_manifest(rows):
    """{row index: (leaf, subroot, root, proof text, steps)} of (doc_id, text, lang, source, n_chars)."""
    leaf = [sha(said(d, s, lang, n, t)) for d, t, lang, s, n in rows]
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[3]].append(i)
    names = sorted(groups, key=first)
    steps = {}

    def grow(nodes, label):
        under = {k: [k] for k in range(len(nodes))}
        digests, out = list(nodes), defaultdict(list)
        while len(digests) > 1:
            runs = [digests[a : a + 3] for a in range(0, len(digests), 3)]
            nxt = defaultdict(list)
            for k, members in under.items():
                for m in members:
                    out[m].append((runs[k // 3][: k % 3], runs[k // 3][k % 3 + 1 :]))
                nxt[k // 3] += members
            digests, under = [sha("".join(r)) for r in runs], nxt
        steps[label] = out
        return digests[0]

    ordered = {g: sorted(groups[g], key=lambda i: (first(rows[i][0]), leaf[i])) for g in names}
    sub = {g: grow([leaf[i] for i in ordered[g]], g) for g in names}
    root = grow([sub[g] for g in names], "all groups")
    out = {}
    for k, g in enumerate(names):
        for at, i in enumerate(ordered[g]):
            path = steps[g][at] + steps["all groups"][k]
            out[i] = (leaf[i], sub[g], root, "".join("".join(a + b) for a, b in path), path)
    return out


def odd_documents():
    rng = random.Random(4)
    rows = [(i, f"text {i}\nsecond line" if i % 3 else f"one line {i}", "en", f"src{min(i % 7, i % 4)}", 5) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "a\nb", None, None, 3), (7, "again\n", "en", "src0", 1), (7, "again\n", "en", "src0", 1), (500, "", "é", "é", 0), (501, "x" * 70000, "", "", 1), (-3, "-", "-", "-", -1)]
    rng.shuffle(rows)
    return rows


def test_manifest_equals_brute_force(spark):
    rows = odd_documents()
    expected = brute_manifest(rows)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", at int").repartition(3)
    out = merkle_manifest.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", ["at"])
    got = out.withColumns({"said": merkle_manifest.proof_text(out["proof"]), "folded": merkle_manifest.fold(out["leaf"], out["proof"])}).collect()
    assert len(got) == len(rows)
    equal_rows = {i for i, r in enumerate(rows) if rows.count(r) > 1}
    for r in got:
        leaf, sub, root, told, _ = expected[r["at"]]
        assert (r["leaf"], r["subroot"], r["root"], r["folded"]) == (leaf, sub, root, root)
        assert r["said"] == told or r["at"] in equal_rows
    assert sorted(r["said"] for r in got) == sorted(x[3] for x in expected.values())


def test_manifest_query_tells_tampered_documents(spark, tmp_path):
    rows = odd_documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    expected = defaultdict(list)
    for i, (leaf, _, root, told, path) in brute_manifest(rows).items():
        d, t, lang, s, n = rows[i]
        tampered = d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0
        now = sha(said(d, s, lang, n, t.replace("\n", ""))) if tampered else leaf
        for a, b in path:
            now = sha("".join(a) + now + "".join(b))
        expected[d].append((leaf, sha(told), now, now == root))
    got = defaultdict(list)
    for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.leaf, r.proof_sha256, r.folded_root, r.verified))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert any(not x[3] for v in got.values() for x in v)


def test_manifest_of_small_and_empty_tables(spark):
    columns = ["doc_id", "text"]
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest.manifest(empty, columns, "source", "doc_id").count() == 0
    one = spark.createDataFrame([(1, "t", "en", None, 1)], SCHEMA)
    (r,) = merkle_manifest.manifest(one, columns, "source", "doc_id", ["doc_id"]).collect()
    assert r.leaf == r.subroot == r.root == sha(said(1, "t")) and r.proof == []
    with pytest.raises(ValueError):
        merkle_manifest.manifest(one.withColumn("Root", one["text"]), columns, "source", "doc_id", ["Root"])


def test_manifest_of_one_hot_group_of_equal_rows(spark):
    rows = [(None, "same", "en", "hot", 4)] * 200 + [(i, "t", "en", f"s{i}", 1) for i in range(5)]
    out = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "text"], "source", "doc_id", ["source"])
    got = out.withColumn("folded", merkle_manifest.fold(out["leaf"], out["proof"])).collect()
    assert len(got) == 205 and all(r.folded == r.root for r in got)
    assert {len(r.proof) for r in got if r.source == "hot"} == {5 + 2}


# -- conversation repair

WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (len(rest) >= 2 and rest == "ua" * (len(rest) // 2))


def brute_repair(rows, most=3):
    """(cost, audit, repaired rows) by all edit sequences with at most `most` inserts."""
    found, best = faults(rows), None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    for picked in itertools.product(*choices):
        base = sum({"D": 3, "K": 0, "Ru": 2, "Ra": 2}[p] + (p != "D" and f == "truncated") for p, f in zip(picked, found, strict=True))
        for n in range(most + 1):
            if best and base + 2 * n > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    audit, out = "", []
                    for i in range(len(rows) + 1):
                        for p, role in zip(places, roles, strict=True):
                            if p == i:
                                audit += "I"
                                out.append(("user" if role == "u" else "assistant", ""))
                        if i < len(rows):
                            audit += picked[i][0]
                            if picked[i] != "D":
                                out.append((rows[i][1] if picked[i] == "K" else {"Ru": "user", "Ra": "assistant"}[picked[i]], rows[i][2]))
                    if all(r for r, _ in out) and legal("".join(r[:1] for r, _ in out)) and (best is None or (base + 2 * n, audit) < best[:2]):
                        best = (base + 2 * n, audit, out)
    return best


def random_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "user", "assistant", ""], ["yes.", "no", "ok!", " \n", "", "why? \t", "a"]
    return [(t, rng.choice(roles), rng.choice(texts)) for t in sorted(rng.sample(range(20), n))]


@pytest.mark.parametrize("piece", [1024, 1, 2])
def test_repairs_equal_all_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    convs = {c: random_rows(rng, rng.randrange(1, 5)) for c in range(60)}
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], "conv_id bigint, turn bigint, role string, text string").repartition(5)
    audits = conversation_repair.repair(df)
    rows = conversation_repair.repaired(df, audits)
    out = defaultdict(list)
    for r in rows.collect():
        assert r.place == len(out[r.conv_id])
        out[r.conv_id].append((r.role, r.text))
    shas = {r.conv_id: r.sha256 for r in conversation_repair.digests(rows).collect()}
    got = {r.conv_id: r for r in audits.collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        cost, audit, kept = brute_repair(rows)
        f, turns, initials = faults(rows), [t for t, _, _ in rows], [r[:1] for _, r, _ in rows]
        r = got[c]
        assert (r.cost, r.audit, out[c]) == (cost, audit, kept)
        assert (r.blank, r.duplicate, r.truncated) == tuple(f.count(x) for x in ("blank", "duplicate", "truncated"))
        assert r.gaps == max(turns) - min(turns) + 1 - len(set(turns))
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert shas.get(c, sha("")) == sha("\n".join(f"{a}:{b}" for a, b in kept))


def test_pieces_of_a_long_conversation_give_the_whole_path():
    rng = random.Random(9)
    rows = [(t, rng.choice("uaasu t")[:1].strip(), rng.choice(["", "", "blank", "truncated", "duplicate"])) for t in range(400)]
    whole = conversation_repair.Piece.of(rows, conversation_repair.STATES)
    for size in (1, 7, 150):
        parts = []
        for a in range(0, len(rows), size):
            parts = conversation_repair._composed([*parts, conversation_repair.Piece.of(rows[a : a + size], conversation_repair.STATES)])
        while len(parts) > 1:
            parts[-2:] = [parts[-2].then(parts[-1])]
        assert parts[0] == whole and parts[0].cheapest() == whole.cheapest()


def test_repair_of_nulls_ties_one_long_conversation_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", 16)
    schema = "conv_id bigint, turn bigint, role string, text string, audit string, conv string"
    rows = [(None, None, None, None), (None, None, "user", "a."), (None, 2, "user", "a."), (1, 5, "user", "x" * 200000), (1, 5, "assistant", "x" * 200000)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(500)] + [(3, 1, "user", "same.")] * 50
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema).repartition(7)
    audits = conversation_repair.repair(df)
    got = {r.conv_id: r for r in audits.collect()}
    assert set(got) == {None, 1, 2, 3}
    assert (got[None].gaps, got[None].blank, got[None].duplicate, got[None].audit) == (0, 1, 1, "DKDI")
    # Rows of one turn are in order of their roles: assistant, then user.
    assert (got[1].cost, got[1].truncated) == (4 + 2, 2)
    assert (got[2].cost, got[2].audit) == (0, "K" * 500)
    assert (got[3].duplicate, got[3].audit) == (49, "K" + "D" * 49 + "I")
    out = [r for r in conversation_repair.repaired(df, audits).collect() if r.conv_id == 2]
    assert [r.text for r in out] == [f"{t}." for t in range(500)]
    empty = df.limit(0)
    assert conversation_repair.repair(empty).count() == 0 and conversation_repair.repaired(empty, audits.limit(0)).count() == 0


def test_conversations_without_rows_after_damage(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", sha(""))


# -- token files

def vocabulary_file():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def odd_texts(rng, n, length):
    parts = [*" \n\t\r\x0b\x0c\xa0　 ​﻿᠎ \x85\x1c\0ab'sé中文，1٣!?-<|>’…", "<|endoftext|>", "  ", "\n\n", "'ll", "A" * 30, "don't ", "word, "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(length))) for _ in range(n)]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("piece", [1 << 19, 40])
def test_chunks_give_the_ids_of_whole_texts(monkeypatch, special, piece):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PIECE_BYTES", piece)
    whole = Tokenizer.from_file(vocabulary_file())
    whole.encode_special_tokens = special
    texts = odd_texts(random.Random(special), 2000, 60) + ["", "x" * 100_000, "word " * 30_000]
    found = token_files.Encoder(vocabulary_file(), special).encode(pa.array(texts))
    assert [x.tolist() for x in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_that_crowd_each_other_out(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "TABLE_BITS", 4)
    monkeypatch.setattr(token_files, "_HIGH", token_files.np.uint64(60))
    monkeypatch.setattr(token_files, "_LOW", token_files.np.uint64(15))
    rng, whole = random.Random(2), Tokenizer.from_file(vocabulary_file())
    encoder = token_files.Encoder(vocabulary_file(), False)
    for _ in range(30):
        texts = odd_texts(rng, 20, 80)
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_file())
    rows = [(i * 3 - 20, t) for i, t in enumerate(odd_texts(random.Random(1), 200, 60))] + [(None, "null id"), (None, None), (4, None), (4, "again"), (4, "again"), (9, "long " * 40_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, ids string, place int").repartition(6)
    encoded = token_files.encode(df, vocabulary_file(), end=0, special_as_text=False)
    path = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(encoded, path, token_files.vocabulary(vocabulary_file()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read(spark, path).collect()
    expected = sorted(((d is not None, d or 0), d, [*whole.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((k[0], k[1], ids) for k, _, ids in expected)
    in_order = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in in_order] == [k for k, _, _ in expected]
    start = 0
    for r in in_order:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    sums = {(r.start, r.ids_crc32) for r in token_files.read(spark, path, "crc32").collect()}
    assert sums == {(r.start, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))) for r in got}
    with open(f"{tmp_path}/ids/manifest.json") as f:
        told = json.load(f)
    assert told["width"] == 2 and told["tokens"] == start and len(told["shards"]) > 1
    assert sum(os.path.getsize(f"{tmp_path}/ids/{s['name']}.tokens") for s in told["shards"]) == 2 * start
    # A second table replaces the first, and its files.
    token_files.write(encoded.limit(0), path, 1 << 17)
    assert token_files.read(spark, path).count() == 0 and not [f for f in os.listdir(f"{tmp_path}/ids") if f.endswith(".tokens")]


def test_a_failed_write_leaves_the_table_before(spark, tmp_path):
    path = str(tmp_path / "ids")
    good = spark.createDataFrame([(1, bytes(8))], "doc_id bigint, ids binary")
    token_files.write(good, path, 1 << 16)
    bad = spark.createDataFrame([(1, bytes(4)), (2, b"\xff\xff\xff\x00")], "doc_id bigint, ids binary").repartition(2, "doc_id")
    with pytest.raises(Exception, match="does not fit"):
        token_files.write(bad, path, 1 << 16)
    assert [tuple(r) for r in token_files.read(spark, path).collect()] == [(1, 0, 2, [0, 0])]
    assert len([f for f in os.listdir(path) if f.endswith(".tokens")]) <= 2


def test_token_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    whole, start = Tokenizer.from_file(vocabulary_file()), 0
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, sf).collect())) == expected
    assert len(expected) == 200


# -- decontamination: seeds lose nothing that the alignment of whole texts accepts

def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def aligned_whole(docs, items):
    """{(doc, item): (score, first word, end)} by the alignment of every whole text with every item, weights from plain counts."""
    texts = [plain_words(t) for _, t in docs]
    held = Counter(w for t in texts for w in set(t))
    number = {w: i + 2 for i, w in enumerate(sorted({w for t in texts for w in t} | {w for _, x in items for w in plain_words(x)}))}
    code = lambda ws: np.array([number[w] for w in ws], np.uint64)
    out = {}
    for item, text in items:
        words = plain_words(text)
        weight = np.array([max(math.log((len(docs) + 1) / (held[w] + 1)) / math.log(len(docs) + 2), decontaminate.LEAST_WEIGHT) for w in words])
        some = [(d, ws) for (d, _), ws in zip(docs, texts, strict=True) if ws]
        scores = decontaminate.align([code(ws) for _, ws in some], [code(words)] * len(some), [weight] * len(some))
        for (d, _), (score, end) in zip(some, scores, strict=True):
            if score >= min(decontaminate.THRESHOLD, decontaminate.LONG_RUN / len(words)):
                out[d, item] = (round(min(score, 1.0), 6), end)
    return out


def test_densely_edited_copies_are_found_as_by_the_whole_alignment(spark):
    rng = random.Random(6)
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    noise = [w for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect() for w in plain_words(r.text)]
    docs, planted = [(i, " ".join(rng.choices(noise, k=rng.randrange(5, 400)))) for i in range(100)], {}
    for every in (3, 4, 5):
        for item, text in items:
            words = text.split()
            phase = rng.randrange(every)
            words = [rng.choice(noise) if k % every == phase else w for k, w in enumerate(words)]
            planted[len(docs)] = (every, item)
            docs.append((len(docs), " ".join([*rng.choices(noise, k=30), *words, *rng.choices(noise, k=30)])))
    # Copies pulled apart by words between theirs, and an item longer than a long run.
    long_item = " ".join(rng.choices(noise, k=400))
    items.append((9999, long_item))
    docs.append((len(docs), " ".join(w if k % 4 else f"{w} between" for k, w in enumerate(items[0][1].split()))))
    docs.append((len(docs), " ".join([*rng.choices(noise, k=50), *long_item.split()[100:180], *rng.choices(noise, k=50)])))
    expected = aligned_whole(docs, items)
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (round(r.score, 6), r.end_word) for r in decontaminate.contaminated(*frames).collect()}
    assert got == expected
    for every, least in ((3, 0.9), (4, 1.0), (5, 1.0)):
        wanted = [(d, i) for d, (e, i) in planted.items() if e == every]
        assert sum(x in got for x in wanted) >= least * len(wanted)


# -- near copies under repeated ids

@pytest.mark.parametrize("hot", [None, 7])
def test_many_texts_under_one_id_take_no_longer(spark, hot):
    rng = random.Random(3)
    texts = []
    for _ in range(100):
        w = [f"w{rng.randrange(500)}" for _ in range(60)]
        texts += [" ".join(w), " ".join([*w[:58], "x", "y"]), " ".join([*w[:57], "z", "y", "q"])]
    rows = list(enumerate(texts, 1000))
    took = []
    for renamed in (rows, [(hot if i % 3 else d, t) for i, (d, t) in enumerate(rows)]):
        began = time.monotonic()
        got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, (r.component_id is not None, r.component_id or 0)) for r in jaccard_join.link(spark.createDataFrame(renamed, "doc_id bigint, text string").repartition(6)).collect())
        took.append(time.monotonic() - began)
        order = lambda d: (d is not None, d or 0)
        expected = []
        for a in range(0, len(renamed), 3):
            least = min(order(d) for d, _ in renamed[a : a + 3])
            expected += [(order(d), 56, least) for d, _ in renamed[a : a + 3]]
        assert got == sorted(expected)
    assert took[1] <= 2 * took[0] + 5


# -- mixing of rows of one id

@pytest.mark.parametrize("hot", [None, 5])
def test_a_third_of_the_rows_under_one_id_are_numbered_in_pieces(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "HOT_ROWS", 20)
    monkeypatch.setattr(mixing, "PIECE_DIGITS", 1)
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(400)] + [(hot, f"h{i % 40}", "en", f"s{i % 3}", 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df, {"s0": 2, "s1": 1}, 1, 4).collect()
    monkeypatch.setattr(mixing, "HOT_ROWS", 10_000)
    plain = mixing.mix(df, {"s0": 2, "s1": 1}, 1, 4).collect()
    assert len(got) == len(rows) and len({(r.slot, r.place_in_block) for r in got}) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, plain))


# -- terms whose lower case is longer

def test_a_name_whose_lower_case_has_marks_is_removed(spark):
    rng = random.Random(1)
    texts = [f"Write to İstanbula at one@mail.org today {k}" for k in range(2)] + [" ".join(rng.choice(["plain", "words", "today", "write"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.find(df).where("doc_id < 2").collect()}
    for k in range(2):
        removed = {texts[k][s["start"] : s["stop"]] for s in found[k].pii if s["kind"] == "removed"}
        assert "İstanbula" in removed
