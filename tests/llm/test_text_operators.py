"""Operators on texts against brute force and the libraries they stand for."""

import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from oracle import difference

from vidspark.llm import bpe, decontaminate, html_text, language_model, licences, quality_rules, sharding, suffix_dedup, token_files

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
PASSAGE = "this very passage of well over fifty bytes is found in several documents of the table"
TEXTS = [
    (1, LONG + ". " + PASSAGE), (2, "Released under the MIT License. " + PASSAGE.upper()), (3, None), (4, ""), (5, "  \n\t "),
    (6, "x"), (7, PASSAGE + " é漢 " + LONG), (8, LONG + ". " + PASSAGE), (9, "Licensed under CC BY-NC 4.0.\n" * 3),
    (10, "the of and " * 60), (11, "a b c d e f g h i j k " * 40), (12, "line one\nline one\n\nline two\n" + LONG * 5),
    (None, "no id " + PASSAGE), (13, "<|endoftext|> mixed  <|endoftext|>\n\n tail  "), (14, "ÀÉ   　 naïve 12,345"),
    (15, "w" * 5000 + " " + LONG), (16, "GNU General Public License, version 3 and Apache License"), (6, "x"),
]
ITEMS = [(100, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (101, "mit license"), (102, None), (103, "..."),
         (None, "no id this"), (100, "tau upsilon this very")]


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing names beside the two columns that count, null ids and texts, repeated rows."""
    rows = [(i, t, 7, "y", "z", True) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, hits string, ids string, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def check_sql(df, sql, tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"CREATE TABLE {name} ({'doc_id' if name == 'documents' else 'item_id'} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert difference(df, con, sql) is None


def unique(docs):
    """Without what SQL can't tell apart: rows with one id, and null ids."""
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


UNIQUE = sorted({i: t for i, t in TEXTS if i is not None}.items())


def test_quality_rules(docs, empty):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    check_sql(quality_rules.judged(unique(docs)).select(*columns), quality_rules.SQL, {"documents": UNIQUE})
    verdicts = [r.kept for r in quality_rules.judged(docs).select("kept").collect()]
    assert len(verdicts) == len(TEXTS) and quality_rules.judged(empty).count() == 0
    kept = quality_rules.kept_rows(docs)
    assert kept.schema == docs.schema and kept.count() == sum(verdicts)


def test_licences(docs, empty):
    def out(rows):
        original = licences.documents
        licences.documents = lambda spark, d: rows
        try:
            return licences.query(rows.sparkSession, "")
        finally:
            licences.documents = original
    check_sql(out(unique(docs)), licences.SQL, {"documents": UNIQUE})
    found = {r.doc_id: r.labels for r in out(docs).collect()}
    assert found[2] == "mit" and found[9] == "cc-by-nc-4.0" and found[16] == "apache,gpl" and found[3] == ""
    assert out(empty).count() == 0


def test_licences_of_bundles(spark):
    notices = [n for _, n, _ in licences.TEMPLATES]
    texts = {1: notices[1] + ". Licensed under CC BY 4.0", 2: "\n\n".join(notices), 3: " ".join(f"x {n}" for n in notices[::-1]),
             4: notices[1] + " licensed under cc by 5 0"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: {x.label for x in r.templates} for r in licences.scanned(docs).collect()}
    labels = {t[0] for t in licences.TEMPLATES}
    assert got == {1: {"mit", "cc-by-4.0"}, 2: labels, 3: labels, 4: {"mit"}}


def test_licences_with_words_changed(spark):
    """Whatever words are rare, a notice whose phrases and enough other words stand is found, and one with less is not."""
    draw, rows, want = random.Random(6), [], {}
    for t, (label, notice, _) in enumerate(licences.TEMPLATES):
        words = notice.split()
        must = {r[2] for r in licences._template_rows() if r[0] == t and r[4]}
        free = [k for k in range(len(words)) if k not in must]
        for k in range(4):
            lost = draw.sample(free, min(len(free), int(len(words) * (1 - licences.MIN_SHARE) + 1e-9) + k % 2))
            changed = [w if i not in lost else "zzz" for i, w in enumerate(words)]
            rows.append((len(rows), "before " * draw.randrange(3) + " ".join(changed)))
            if len(lost) <= len(words) * (1 - licences.MIN_SHARE) + 1e-9:
                want[len(rows) - 1] = label
        rows.append((len(rows), " ".join(w if i != min(must) else "zzz" for i, w in enumerate(words))))
    rows += [(1000 + k, "warranty conditions license copyright " * 30) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.label for x in r.templates} for r in licences.scanned(docs).collect()}
    assert all(label in got[i] for i, label in want.items())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = {i: set(x.split(",")) - {""} for i, x in con.execute(f"SELECT doc_id, labels FROM ({licences.SQL})").fetchall()}
    assert all(got[i] <= found[i] and found[i] - got[i] <= set(licences.BASE.values()) for i in found)


def test_index_words_are_the_rarest_of_the_phrases():
    for few in ("hereby", "charge", "sublicense", "restriction"):
        counts = {w: 9 for words in licences.mandatory_words().values() for w in words} | {few: 1}
        index = licences.rarest(counts)
        assert all(set(index[t]) <= set(words) and 0 < len(index[t]) <= licences.MIN_VOTES
                   for t, words in licences.mandatory_words().items())
        assert all(few in index[t] for t, words in licences.mandatory_words().items() if few in words)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (decontaminate.BLOCK_WINDOWS, 2):  # one broadcast block or several
        found = {(r.doc_id, r.hits.n_words): r.hits for r in decontaminate.find_hits(docs, items, block_windows=block).collect()}
        assert [list(zip(h.starts, h.ends)) for k, h in found.items() if k[0] == 1] == [[(1, 12), (18, 22)]]
        assert [h.items for k, h in found.items() if k[0] == 2] == [["101"]] and found[(None, 18)].items == ["null"]
        assert not found[(3, 0)].items and len(found) == len(set(TEXTS))
    clean = decontaminate.clean_documents(docs, items, max_share=1.0)
    assert clean.schema == docs.schema and clean.count() == len(TEXTS)
    assert next(r.text for r in clean.collect() if r.doc_id == 2).startswith("Released under the . THIS")
    kept = decontaminate.clean_documents(docs, items, mode="documents")
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 7, 8, None})
    assert decontaminate.find_hits(empty, items).count() == 0
    assert all(not r.hits.items for r in decontaminate.find_hits(docs, items.where("false")).collect())
    with pytest.raises(ValueError):
        decontaminate.clean_documents(docs, items, mode="other")


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.tokenizer_path())
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.round_trip(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want and Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()) == want
    assert bpe.round_trip(empty).count() == 0


def test_pieces_of_random_texts(monkeypatch):
    from tokenizers import Tokenizer
    library, encoder, draw = Tokenizer.from_file(bpe.tokenizer_path()), bpe.Encoder(bpe.tokenizer_path()), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "'ll", "'", "ß", "×", "ɏ", "Ȁ", " Word.", ",\nNext", "é", " ", "　", "12", ".", "!!", "漢", "​",
             "�", "\x00", "😀", "\x85", "\r"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(25))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(bpe, "REMEMBERED", 500)
    many = bpe.Encoder(bpe.tokenizer_path())
    for k in range(0, len(texts), 100):  # generations come and go
        for text, ids in zip(texts[k:k + 100], many.encode([t.encode() for t in texts[k:k + 100]])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert many.old.place and len(many.new.place) < 2 * 500
    one = " ".join(texts)
    assert encoder.encode([one.encode()])[0].tolist() == library.encode(one, add_special_tokens=False).ids
    assert encoder.encode([b"", b"x", b""])[0].tolist() == [] and encoder.encode([]) == []
    ids = [draw.randrange(50257) for _ in range(500)]
    assert encoder.vocabulary.decode(np.array(ids, np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_token_files(spark, docs, empty, tmp_path):
    parts = token_files.write_tokens(docs, f"file://{tmp_path}/set")
    assert json.loads((tmp_path / "set" / "parts.json").read_text()) == parts
    rows = sorted(token_files.read_tokens(spark, f"file://{tmp_path}/set", parts).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    ids, offsets, names, _ = token_files.open_part(f"file://{tmp_path}/set", parts[0])
    assert isinstance(ids, np.memmap) and ids.dtype == np.dtype("<u2") and offsets.dtype == np.dtype("<u8")
    assert offsets[-1] == len(ids) and len(names) == parts[0]["documents"]
    none = token_files.write_tokens(empty, f"{tmp_path}/none")
    assert none == [] and token_files.read_tokens(spark, f"{tmp_path}/none", none).count() == 0


def brute_repeats(rows, length=50):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k:k + length], suffix_dedup.NO_ID if i is None else i)
    for i, t in rows:
        data, own = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if first[data[k:k + length]] < own:
                gone[k:k + length] = True
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = int((gone[:-1] & ~gone[1:]).sum())
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("largest", [suffix_dedup.LARGEST, 1])
def test_repeated_strings(spark, docs, empty, largest, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    assert Counter(map(tuple, suffix_dedup.digests(docs).collect())) == brute_repeats(TEXTS)
    draw = random.Random(5)
    base = "".join(draw.choices("abcdefgh ", k=900))
    rows = [(int(k), "".join(draw.choices("xyz", k=draw.randrange(30))) + base[a:a + draw.randrange(40, 400)] + "é" * draw.randrange(3)
             + base[draw.randrange(800):]) for k, a in enumerate(draw.choices(range(850), k=60))] + [(70, "ab" * 400), (71, "ba" * 300)]
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, suffix_dedup.digests(some).collect())) == brute_repeats(rows)
    kept = suffix_dedup.deduplicated(docs)
    assert kept.schema == docs.schema and PASSAGE not in "".join(r.text or "" for r in kept.collect() if r.doc_id in (7, 8, None))
    assert suffix_dedup.digests(empty).count() == 0


@pytest.mark.parametrize("largest,part", [(suffix_dedup.LARGEST, 1 << 19), (1, 7)])
def test_repeats_of_long_texts_and_hot_anchors(spark, monkeypatch, largest, part):
    """Texts longer than what is worked on at once, a passage across that edge, and one anchor with many surroundings."""
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 13)
    draw = random.Random(12)
    fresh = lambda n: "".join(draw.choices("abcdefghij klmnop", k=n))
    passage, hot = fresh(400), fresh(24)
    rows = [(1, fresh(8100) + passage + fresh(20_000)), (2, fresh(30) + passage + fresh(9000)), (3, fresh(16_300) + passage[100:300] + fresh(90))]
    rows += [(i, fresh(13) + hot + draw.choice(["x" * 40, "y" * 40, fresh(40)])) for i in range(10, 90)]
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, suffix_dedup.digests(some).collect())) == brute_repeats(rows)


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in [*range(1, 12), 50, 333, 1000]:
        text = np.tile(rng.integers(0, 3, n).astype(np.uint8), 2)
        data = text.tobytes()
        assert suffix_dedup.suffix_order(text).tolist() == sorted(range(2 * n), key=lambda i: data[i:])


def test_language_model(spark, docs, empty):
    rows = docs.select("doc_id", "text")
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in language_model.scored(rows).collect())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = Counter(w for i, t in TEXTS if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in TEXTS:
        score = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t))
        want[i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(float(score), 6)] += 1
    assert got == want and language_model.scored(empty).count() == 0


def test_model_is_normalised_and_learns(spark):
    rng = np.random.default_rng(1)
    totals = np.full(40, 100.0)
    packed = language_model.triples(np.tile(np.arange(39), 30).astype("<u2"), 39)
    trainer = language_model.Trainer(language_model.initial(totals), totals, 1)
    for _ in range(300):
        trainer.run(*np.unique(packed, return_counts=True))
    one, two, total = language_model.log_tables(trainer.p)
    a, b = rng.integers(0, 40, (2, 20))
    np.testing.assert_allclose((10 ** (one[a] + two[b] - total[a, b][:, None]).astype(np.float64)).sum(1), 1, atol=1e-4)
    at = packed[5:30]
    assert (one[at >> 20, at & 1023] + two[at >> 10 & 1023, at & 1023] - total[at >> 20, at >> 10 & 1023]).mean() > np.log10(1 / 40) + 0.5


def test_held_out_texts_score_better_than_single_words(spark):
    out = language_model.query(spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_sharding(docs, empty):
    many = docs.unionByName(docs).unionByName(docs)
    rows = sharding.assigned(many, shards=5, sources=4).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 3 * len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS * 3)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.assigned(many, shards=5, sources=4).collect() and sharding.assigned(empty).count() == 0
    assert {tuple(r) for r in sharding.assigned(many, shards=5, sources=4).collect()} == {tuple(r) for r in rows}


def test_communication_matrix_is_hypergeometric():
    draws = [sharding.communication_matrix([6, 4], 2, seed)[0][0] for seed in range(4000)]
    share = Counter(draws)  # 6 of 10 rows, of which 5 go to shard 0: C(6,k) C(4,5-k) / C(10,5)
    for k, want in {1: 6, 2: 60, 3: 120, 4: 60, 5: 6}.items():
        assert abs(share[k] / 4000 - want / 252) < 0.03
    matrix = sharding.communication_matrix([100, 0, 37, 3], 7, 1)
    assert [sum(r) for r in matrix] == [100, 0, 37, 3] and {sum(c) for c in zip(*matrix)} == {20}


PAGE = ('<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><a>Menu</a></nav>'
        '<div id="cookie-notice">Cookies</div><main><article><h1>One&nbsp;&amp; two</h1><p>a<b>b</b> c<p>d <!-- x --> e'
        '<div class="box">Read on</div><section class="comments"><article class="comment">no</article></section><form>f</form>'
        '<script>if (a < b) "</p>"</script>{}</article><aside>x</aside></main><footer>F</footer>')


def test_html_text(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.replace("{}", f"<p>own {k}</p>")) for k in range(8)]
    rows += [(8, "http://b.example/", PAGE.replace("{}", "")), (9, None, None), (10, "x", ""), (11, "http://c/", "<p>one<p>two</div> 1 < 2 &am"),
             (12, "http://a.example/0", PAGE.replace("{}", "<p>own 0</p>")), (13, "http://d", "text <!-- open"), (14, "http://d", "<div>" * 3000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert all(got[k] == f"One & two ab c d e own {k}" for k in range(8)) and got[12] == got[0]  # the box recurs on the host
    assert got[8] == "One & two ab c d e Read on" and got[9] == got[10] == got[14] == ""
    assert got[11] == "one two 1 < 2 &am" and got[13] == "text"
    assert html_text.extracted(pages.where("false")).count() == 0


def test_html_text_outside_articles():
    teasers = "<body><nav>n</nav><div><h1>Story</h1><p>long text</p></div><article>teaser</article><aside>x</aside></body>"
    assert html_text.read_page(teasers)[0] == "Story long text teaser"
    assert html_text.read_page("<main><h1>Head</h1><p>lead</p><article><p>body</p></article></main>")[0] == "Head lead body"
    assert html_text.read_page("<div>before</div><main>in</main><footer>f</footer>")[0] == "before in"


def test_bpe_of_a_whole_table_equals_the_library():
    import duckdb as db
    from tokenizers import Tokenizer
    texts = [(t or "") for t, in db.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    library, encoder = Tokenizer.from_file(bpe.tokenizer_path()), bpe.Encoder(bpe.tokenizer_path())
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want


def test_shared_anchors_leave_packed_by_part():
    """Rows follow parts, not documents; each document gets the anchors it shares, whatever divides its id."""
    draw = random.Random(6)
    fresh = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    shared, parts = fresh(300), 4
    ids = [8 * k for k in range(500)]
    texts = [fresh(100) + shared + fresh(100) for _ in ids]
    entries = []
    for a in range(0, 500, 100):  # five tasks
        batch = pa.RecordBatch.from_arrays([pa.array(ids[a:a + 100], pa.int64()), pa.array(texts[a:a + 100])], names=["_id", "text"])
        entries += list(suffix_dedup._anchor_entries(0, "text", parts)(iter([batch])))
    rows = pa.Table.from_batches(entries)
    found = {}
    for bucket in range(parts):
        own = rows.filter(pa.compute.equal(rows["bucket"], bucket)).to_batches()
        out = pa.Table.from_batches(list(suffix_dedup._shared_anchors(parts)(iter(own)))).to_pylist()
        assert len(out) <= 2 * parts
        for row in out:
            of, hashes = suffix_dedup._unpacked(row["ids"], row["counts"], row["hashes"])
            assert set(suffix_dedup._parts(of, parts).tolist()) == {row["part"]}
            for i, h in zip(of.tolist(), hashes.tolist()):
                found.setdefault(i, set()).add(h)
    common = set.intersection(*found.values())
    assert set(found) == set(ids) and common
    assert len({int(p) for p in suffix_dedup._parts(np.array(ids), parts)}) == parts


def test_texts_cross_the_network_once(spark, capsys):
    """Contexts and the removal read one exchange of the texts."""
    rows = [(k, f"{k} " * 30 + PASSAGE * 3) for k in range(200)]
    some = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, some.collect())) == brute_repeats(rows)
    some.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0].splitlines()
    # one of the documents, read twice, and one of the removed ranges
    by_part = [line for line in plan if "Exchange shufflepartitionidpassthrough" in line]
    assert sum("ReusedExchange" in line for line in by_part) == 1
    assert sum("ReusedExchange" not in line for line in by_part) == 2


def test_small_entries_and_ranges():
    """An anchor costs little more than six bytes, and touching ranges of a text are sent as one."""
    import zstandard
    rng = np.random.default_rng(8)
    ids, hashes = np.sort(rng.integers(-1 << 62, 1 << 62, 500))[rng.integers(0, 500, 20_000)], rng.integers(0, 1 << 63, 20_000, np.uint64)
    ids[:50], ids[50:90] = suffix_dedup.NO_ID, -1 << 63
    buckets = (hashes % np.uint64(3)).astype(np.int64)
    rows = suffix_dedup._packed(ids, hashes, buckets)
    assert sum(len(x) for row in rows for x in row[1:]) < 7.2 * len(ids)
    low = np.uint64((1 << 48) - 1)
    for bucket, *packed in rows:
        of, sent = suffix_dedup._unpacked(*packed)
        own = buckets == bucket
        assert sorted(zip(of.tolist(), sent.tolist())) == sorted(zip(ids[own].tolist(), (hashes[own] & low).tolist()))
    spans = np.array([[4, 9, k, k + 60] for k in range(0, 3000, 10)] + [[4, 9, 5000, 5060], [4, 8, 5030, 5090], [5, 9, 0, 50], [5, 9, 50, 100]], "<i8")
    packed = zstandard.ZstdCompressor().compress(np.ascontiguousarray(spans[rng.permutation(len(spans))]).tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([packed])], names=["bucket", "spans"])
    out = pa.Table.from_batches(suffix_dedup._by_document(iter([batch]))).to_pylist()
    got = [(x["text"], np.frombuffer(x["spans"], "<i8").tolist()) for row in out for x in list(row.values())[1]]
    assert [row["id"] for row in out] == [4, 5]
    assert got == [(8, [5030, 5090]), (9, [0, 3050, 5000, 5060]), (9, [0, 100])]
