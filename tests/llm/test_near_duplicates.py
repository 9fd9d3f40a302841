"""Fingerprints, links, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from vidspark.llm import decontaminate, near_copies, quality_rules, simhash
from vidspark.llm.graph import components
from vidspark.session import materialize


def brute_components(prints, max_bits):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in prints:
        for b in prints:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in prints}


def brute_print(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxh64_intdigest(b" ".join(found[k:k + words]), 42) for k in range(max(1, len(found) - words + 1))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("max_bits,large", [(4, 128), (4, 2), (5, 128), (7, 3)])
def test_links_are_complete(spark, monkeypatch, max_bits, large):
    monkeypatch.setattr(simhash, "LARGE_KEY", large)
    draw = random.Random(max_bits)
    prints = {0}
    for _ in range(12):  # clusters around centres, chains, and strangers that share a segment
        centre = draw.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in draw.sample(range(64), draw.randrange(7)):
                x ^= 1 << b
            prints.add(x)
    base = draw.getrandbits(64)
    prints |= {base ^ (draw.getrandbits(40) << 24) for _ in range(150)}
    prints = {p - (1 << 64) if p >= 1 << 63 else p for p in prints}
    want = brute_components(prints, max_bits)
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.fp: r.label for r in simhash.linked(rows, max_bits).collect()}
    assert {p: got.get(p, p) for p in prints} == want


def test_near_duplicates_of_documents(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(words[:299] + ["other"])), (9, " ".join(words).upper()), (4, None), (2, ""), (7, " \n"),
            (None, " ".join(words)), (8, "a b"), (8, "a b"), (1, " ".join(words[::-1])), (6, "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    prints = {t: brute_print(t) for _, t in rows}
    label = brute_components(set(prints.values()), 4)
    first = {}
    for i, t in rows:
        if i is not None:
            first[label[prints[t]]] = min(i, first.get(label[prints[t]], i))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((i, prints[t], first[label[prints[t]]]) for i, t in rows), key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (300, 300), (7, 500)] + [(1000, k) for k in range(1001, 1050)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 500: 0, 100: 100, 200: 100, **{k: 1000 for k in range(1000, 1050)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(1)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randrange(3, 9))) for _ in range(3000)]
    text = lambda n=150: " ".join(draw.choice(["the", "of", "and", *draw.choices(vocabulary, k=6)]) for _ in range(n))
    clean = {i: text() for i in range(30)}
    item, passage, copied = text(20), text(60), text(300)
    rows = {**clean, 40: copied, 41: copied, 42: copied.replace(" the ", " a ", 1), 50: clean[3] + " " + item + " " + text(100),
            60: text() + "\n" + passage + "\n" + text(), 61: text() + "\n" + passage + "\n" + text(), 70: "short", 71: None, 72: "%% " * 200}
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows.items()], "doc_id long, text string, kept string, n_words int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.schema == docs.schema, name
    left = {r.doc_id: r.text for r in kept.collect()}
    assert {i: left.get(i) for i in clean} == clean  # clean documents stay as they are
    assert set(left) == {*clean, 40, 50, 60, 61} and passage in left[60] and passage not in left[61]
    assert not set(zip(*[item.split()[k:] for k in range(10)])) & set(zip(*[left[50].split()[k:] for k in range(10)]))
    out = corpus_pipeline.encoded(spark, kept, str(tmp_path))
    assert out.count() == len(left) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, str(tmp_path)), name)
        assert none.count() == 0


def test_near_duplicate_stage_keeps_the_smallest_id(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u"), (None, "p q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert len(out) == 2 and out[1] == (None, "p q r s t u") and out[0][1] == "a b c d e f"


def test_rules_and_windows_are_what_the_pipeline_uses():
    assert quality_rules.RULES[0][2] == 50 and decontaminate.WINDOW == 10 and np.all(np.array(corpus_pipeline.SHINGLE_WORDS) == 5)


def test_near_duplicate_stage_finds_all_of_similarity_four_fifths(spark):
    draw = random.Random(8)
    fresh = lambda n: ["".join(draw.choices("abcdefghij", k=8)) for _ in range(n)]
    rows, words_of = [], {}
    for group in range(40):  # a text, and copies of it with words changed here and there
        base = fresh(draw.choice([60, 150, 400]))
        for k, share in enumerate((0, 0.01, 0.02, 0.022, 0.03, 0.06)):
            words_of[10 * group + k] = [w if draw.random() >= share else fresh(1)[0] for w in base]
    hub = fresh(200)  # two copies of the hub are less alike than each is to the hub
    for k in range(25):
        words_of[1000 + k] = hub[:5 * k] + fresh(1) + hub[5 * k + 1:100] + hub[100:] + fresh(18 if k else 0)
    rows = [(i, " ".join(w)) for i, w in words_of.items()]
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in words_of.items()}
    root = {i: i for i in sets}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and root[i] != root[j] and alike(i, j):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(root.values()) and len(kept) < len(rows)


def test_near_duplicate_stage_keeps_other_texts_of_one_id(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (2, "v w x y z a"), (2, "v w x y z a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert out == [(1, "a b c d e f"), (2, "p q r s t u"), (2, "v w x y z a")]


def test_keys_of_similar_texts_meet():
    draw, missed, met = np.random.default_rng(3), 0, []
    for n in (50, 50, 450, 450) * 50:
        both, own = draw.integers(0, 1 << 63, (8 * n // 10,), np.uint64), draw.integers(0, 1 << 63, (2, n // 10), np.uint64)
        a, b = (near_copies.band_keys(np.concatenate((both, x))) for x in own)
        met.append(int((a == b).sum()))
        missed += met[-1] == 0
    assert not missed and abs(np.mean(met) - near_copies.BANDS * 0.8 ** near_copies.ROWS) < 1.5


def test_near_duplicate_stage_links_by_fingerprints(spark, monkeypatch):
    """Without any key the links between fingerprints are left, and only those that the shingles bear out."""
    monkeypatch.setattr(near_copies, "_keys", lambda rows, words: rows.select("node", F.col("node").alias("key")).where("false"))
    draw = random.Random(5)
    fresh = lambda n: ["".join(draw.choices("abcdefghij", k=8)) for _ in range(n)]
    base, far = fresh(400), fresh(400)
    near = base[:-1] + fresh(1)
    low = [w for k, w in enumerate(base) if k % 6]  # shares too few shingles
    prints = [brute_print(" ".join(w), 5) & (2 ** 64 - 1) for w in (base, near)]
    assert (prints[0] ^ prints[1]).bit_count() <= corpus_pipeline.MAX_BITS
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, far, near, low))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 1, 3}
    monkeypatch.setattr(near_copies.simhash, "linked", lambda fps, max_bits: fps.select("fp", F.lit(0).cast("long").alias("label")))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} >= {1, 3}
