import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidspark.functions import arrays, hashing, numeric, probe, text


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_url_patterns(spark):
    urls = ["https://www.youtube.com/watch?v=abc-12&t=3", "https://youtu.be/xyz?t=1", " https://twitter.com/u/status/99 ",
            "https://www.facebook.com/p/videos/123/", "https://example.com/watch?v=abc", "", None]
    got = [r["p"] and tuple(r["p"]) for r in values(spark, [(u,) for u in urls], "u string", p=text.url_parts(F.col("u")))]
    assert got == [("abc-12", "youtube"), ("xyz", "youtube"), ("99", "twitter"), ("123", "facebook"), None, None, None]


def test_label_texts(spark):
    words = ["real", "Fake ", "\tAUTHENTIC\n", "tampered", "0", "1", "true", "uncertain", None]
    assert [r["x"] for r in values(spark, [(w,) for w in words], "w string", x=text.label_from_text(F.col("w")))] == \
        [0, 1, 0, 1, 0, 1, 1, None, None]
    nums = [0.0, 1.0, 1.9, -1.9, float("nan"), None]
    assert [r["x"] for r in values(spark, [(n,) for n in nums], "n double", x=text.label_from_number(F.col("n")))] == \
        [0, 1, 1, -1, None, None]


def test_match_keys(spark):
    paths = ["a/FX5_aug1_scaled_aug1.mp4", "a/FX5_aug1.mp4", "FX5_augX.mp4", "set/yt/ID9/video.mp4", "video.mp4",
             "x/ID_aug 3 .mp4", "ID_aug1_aug2.mp4", "a.b/.hidden", "n.o.mp4", None]
    got = [r["k"] for r in values(spark, [(p,) for p in paths], "p string", k=text.match_key(F.col("p")))]
    assert got == ["fx5_aug1", "fx5_aug1", "fx5", "id9", "video", "id_aug 3 ", "id_aug1", ".hidden", "n.o", "none"]


def test_clip_ids(spark):
    paths = ["set/youtube/IJf_x-1/video.mp4", "video.mp4", "/video.mp4", "a b/v.mp4", "é1/v.mp4", "./v.mp4"]
    got = [r["k"] for r in values(spark, [(p,) for p in paths], "p string", k=text.clip_id(F.col("p")))]
    assert got == ["IJf_x-1", hashlib.md5(b"video.mp4").hexdigest()[:12], "_", "a_b", "é1", hashlib.md5(b"./v.mp4").hexdigest()[:12]]


def test_augmented_names(spark):
    paths = ["o/v_aug3.mp4", "o/v_original.mp4", "o/v_augx.mp4", "o/v.mp4", "o/v_aug1_aug2.mp4"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").withColumn("s", text.stem(F.col("p")))
    got = [r["x"] and tuple(r["x"]) for r in df.select(text.augmented_name_parts(F.col("s")).alias("x")).collect()]
    assert got == [("v", 3, False), ("v", -1, True), None, None, ("v", 1, False)]


def test_find_column():
    assert text.find_column(["x", "Label", "class"], text.LABEL_COLUMNS) == "class"
    with pytest.raises(ValueError):
        text.find_column(["x"], text.LABEL_COLUMNS)


def test_seeds_match_python(spark):
    paths = ["a/b.mp4", "é/x", ""]
    got = [r["s"] for r in values(spark, [(p,) for p in paths], "p string", s=hashing.seed_of(F.col("p")))]
    assert got == [int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 2 ** 31 for p in paths]


def test_config_hash_matches_json(spark):
    rows = [("r1", "m\"x", 8, True, None), ("r2", "m\"x", 8, True, None)]
    df = spark.createDataFrame(rows, "run_id string, model string, batch int, amp boolean, note string")
    got = [r["h"] for r in df.select(hashing.config_hash(df, df.columns).alias("h")).collect()]
    text_form = json.dumps({"model": 'm"x', "batch": 8, "amp": True, "note": None}, sort_keys=True)
    assert got == [hashlib.sha256(text_form.encode()).hexdigest()[:16]] * 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.integers(1, 60)), min_size=1, max_size=40))
def test_even_indices_match_linspace(spark, pairs):
    got = values(spark, pairs, "n int, k int", n=F.col("n"), k=F.col("k"), i=arrays.even_indices(F.col("n"), F.col("k")))
    for r in got:
        assert r["i"] == np.linspace(0, r["n"] - 1, r["k"], dtype=int).tolist()


def test_step_indices(spark):
    def plain(total, k):
        if total <= 0:
            return []
        return [i % total for i in range(k)] if total <= k else [int(total / float(k) * i) for i in range(k)]

    got = values(spark, [(n,) for n in range(0, 60)], "n int", n=F.col("n"), i=arrays.step_indices(F.col("n"), 7))
    assert all(r["i"] == plain(r["n"], 7) for r in got)


@pytest.mark.parametrize("window,stride", [(10, None), (10, 3), (7, 20), (1, None)])
def test_rolling_windows(spark, window, stride):
    def plain(total):
        step = stride or max(1, window // 2)
        if total <= 0:
            return []
        if total <= window:
            return [0]
        out = list(range(0, total - window + 1, step))
        return out if out[-1] + window >= total else out + [total - window]

    got = values(spark, [(n,) for n in range(0, 65)], "n int", n=F.col("n"), w=arrays.window_starts(F.col("n"), window, stride))
    assert all(r["w"] == plain(r["n"]) for r in got)


def test_sequence_changes_keep_order_and_repeat(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), F.sequence(F.lit(0), F.lit(19)).alias("s"))
    dropped = df.select(arrays.drop_some(F.col("s"), F.col("k"), 0.5).alias("s")).collect()
    sizes = {len(r["s"]) for r in dropped}
    assert all(r["s"] == sorted(set(r["s"])) for r in dropped) and min(sizes) >= 15 and max(sizes) == 20
    twice = df.select(arrays.repeat_some(F.col("s"), F.col("k"), 0.5).alias("s")).collect()
    assert all(sorted(set(r["s"])) == list(range(20)) and r["s"] == sorted(r["s"]) for r in twice)
    back = df.select(arrays.reverse_some(F.col("s"), F.col("k"), 0.5).alias("s")).collect()
    turned = sum(r["s"][0] == 19 for r in back)
    assert 100 < turned < 200 and dropped == df.select(arrays.drop_some(F.col("s"), F.col("k"), 0.5).alias("s")).collect()


def test_augmentation_plans(spark):
    rows = values(spark, [(i,) for i in range(50)], "s long", p=arrays.augmentation_plan(F.col("s"), 10), q=arrays.augmentation_plan(F.col("s"), 3))
    assert all(sorted(r["p"]) == sorted(arrays.AUGMENTATION_TYPES) for r in rows)
    assert len({tuple(r["p"]) for r in rows}) > 40
    assert all(sorted(r["q"]) == sorted(arrays.AUGMENTATION_TYPES[:3]) for r in rows)


def test_scores(spark):
    r = values(spark, [(2.0, 1.0), (0.5, 0.5)], "a double, b double", s=numeric.sigmoid(F.col("a")),
               p=numeric.softmax([F.col("a"), F.col("b")])[0], m=numeric.argmax([F.col("a"), F.col("b")]),
               hi=numeric.above(F.col("b")), ge=numeric.at_least(F.col("b")))
    assert r[0]["s"] == pytest.approx(1 / (1 + np.exp(-2))) and r[0]["p"] == pytest.approx(np.exp(2) / (np.exp(2) + np.e))
    assert (r[0]["m"], r[1]["m"], r[1]["hi"], r[1]["ge"]) == (0, 0, 0, 1)


def test_probe(spark):
    good = json.dumps({"format": {"duration": "10.5", "bit_rate": "900", "size": "77"}, "streams": [
        {"codec_type": "audio", "bit_rate": "1"}, {"codec_type": "video", "width": 640, "height": 360, "r_frame_rate": "30000/1001",
                                                   "codec_name": "h264", "bit_rate": "800", "pix_fmt": "yuv420p"}]})
    rows = spark.createDataFrame([(good,), ("{}",), ("nonsense",), (None,)], "j string") \
        .select(*[c.alias(n) for n, c in probe.probe_columns(F.col("j")).items()]).collect()
    assert rows[0]["frame_count"] == int(10.5 * 30000 / 1001) and rows[0]["width"] == 640 and rows[0]["bitrate"] == 800
    assert all(v is None for r in rows[1:] for v in r)
    cues = spark.createDataFrame([(good,), ("nonsense",)], "j string") \
        .select(*[c.alias(n) for n, c in probe.codec_cues(F.col("j")).items()]).collect()
    assert tuple(cues[0]) == (1.0, 30.0, 0.0) and tuple(cues[1]) == (0.0, 30.0, 0.0)
