import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vidspark.llm import disclosure

SCHEMA = "doc_id long, text string, key string, base int, terms string"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    """The stated rules, with the patterns as stated."""
    spans = []
    for k, kind in enumerate(disclosure.KINDS):
        for m in re.finditer(disclosure.PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def found(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)
    rows = disclosure.entities(docs, **more).collect()
    return {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in rows}


CARD = "4539578763621486"


def test_base_spans_equal_the_stated_rules(spark):
    draw = random.Random(5)
    pieces = ["a@b.c", "A.b+c@x-y.Org.", "@", ".", "+", "-", " ", "1", "255", "256", "007", "1.2.3.4", "é", "😀", "x", "_", "%",
              CARD, "4539 5787-6362 1486", "+49 (30) 1234.567-8", "+1", "555-1234", "\n", "d@e", "c_d@e.f", "0.0.0.0.1", "\x00", "$"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", f"x{CARD}x", "++1 234 567 890 1", "+1" + " " * 50]
    got = found(spark, texts)
    assert {i: base_spans(t) for i, t in enumerate(texts)} == got
    assert sum(map(len, got.values())) > 300


def test_long_runs_and_many_spans(spark):
    """Runs that a pattern could go back over, more spans than a block of running sums has, and text beyond the BMP."""
    many = "😀 a@b.cd, " * 700
    texts = ["a" * 300_000 + "@", "1" * 300_000, "1 " * 100_000, "x." * 150_000, "+1" + "-" * 200_000, "a@" + "b." * 150_000 + "c", many]
    got = found(spark, texts)
    assert got[0] == [] and got[3] == [] and got[4] == []
    assert got[5] == [(0, 0, 300_003)]
    assert got[6] == base_spans(many) and len(got[6]) == 700


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(disclosure.running_sums(F.lit(list(range(n))).cast("array<bigint>")).alias("s")).head()
        assert row["s"] == [i * (i + 1) // 2 for i in range(n)]


def corpus():
    """Zork stands near one address in four different texts and hardly elsewhere, 'contact' in most texts."""
    rows = [(i, f"contact Zork {'abcdefgh'[i]}{'pqrstuvw'[i]}q at z.ork@mail.example.com soon") for i in range(4)]
    rows += [(4, "i met zork yesterday"), (5, None), (6, "")]
    rows += [(i, f"contact us about {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}thing") for i in range(7, 60)]
    return rows


@pytest.mark.parametrize("sent", [200_000, 0])
def test_disclosing_terms(spark, monkeypatch, sent):
    monkeypatch.setattr(disclosure, "SENT_TERMS", sent)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in disclosure.scanned(docs).collect()}
    assert len(rows) == 60
    # 4 of 5 documents with zork have it near the address; the parts of the address itself are base spans
    assert [(t["start"], t["end"]) for t in rows[4]["terms"]] == [(6, 10)]
    assert rows[4]["terms"][0]["share"] == 0.8
    assert (8, 12) in [(t["start"], t["end"]) for t in rows[0]["terms"]]
    texts = {i: t for i, t in corpus()}
    for i in range(4):  # no word of one text alone, nor a common one
        assert {texts[i][t["start"]:t["end"]].lower() for t in rows[i]["terms"]} <= {"zork", "soon"}
    assert all(not rows[i]["terms"] for i in range(5, 60))


def test_sanitised_text(spark):
    docs = spark.createDataFrame(corpus() + [(4, "i met zork yesterday")], "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in disclosure.sanitised(docs).collect()]
    assert len(out) == 61 and out.count((4, "i met [term] yesterday")) == 2
    texts = dict(out)
    assert texts[0] == "contact [term] apq at [email] "  # soon stands nowhere else and goes
    assert texts[5] == texts[6] == ""
    assert texts[30] == corpus()[30][1]


def test_copies_are_one_text_of_evidence(spark):
    rows = [(i, "contact Zork at z.ork@mail.example.com soon") for i in range(4)] + [(9, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["terms"] == [] for r in disclosure.scanned(docs).collect())


def test_query_on_nulls_and_an_empty_table(spark, tmp_path):
    empty = hashlib.sha256(b"").hexdigest()
    spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "1.2.3.4", "c")],
                          "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = disclosure.query(spark, f"{tmp_path}/a").collect()
    assert sorted((r["doc_id"] or 0, r["n_ip"], r["spans"]) for r in rows) == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 1, "ip:0:7")]
    assert {r["base_sha256"] for r in rows if not r["n_ip"]} == {empty}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert disclosure.query(spark, f"{tmp_path}/b").collect() == []
