import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_splits import plan_of

from vidspark.operators import features as fe


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(0, 1, 200)
    data = np.stack([a, a * 2 + rng.normal(0, 0.01, 200), rng.normal(0, 1, 200), np.full(200, 3.0)], axis=1)
    return data, spark.createDataFrame([tuple(map(float, r)) for r in data], "f0 double, f1 double, f2 double, f3 double")


def test_correlated_and_constant_columns_go(matrix):
    _, df = matrix
    assert fe.FeaturePruner().fit(df, df.columns).kept == ["f1", "f2"]
    assert fe.FeaturePruner(method="none").fit(df, df.columns).kept == ["f0", "f1", "f2"]
    assert fe.FeaturePruner(method="vif").fit(df, df.columns).kept == ["f2"]
    assert fe.FeaturePruner().fit(df, []).kept == [] and fe.FeaturePruner().fit(df, ["f3"]).kept == ["f3"]


def test_pair_order_is_kept():
    corr = np.array([[1, .99, .99], [.99, 1, .1], [.99, .1, 1]])
    assert fe.weaker_of_pairs(corr, [1.0, 2.0, 0.5], 0.95) == {0, 2}  # 0 falls to 1 and still takes 2 with it
    assert fe.weaker_of_pairs(np.array([[1, np.nan], [np.nan, 1]]), [1.0, 1.0], 0.95) == set()


@pytest.mark.parametrize("imputation", ["mean", "median", "most_frequent", "constant"])
@pytest.mark.parametrize("scaling", ["standard", "robust", None])
def test_preprocessing_matches_numpy(spark, imputation, scaling):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (150, 2)).astype(float)
    x[::7, 0] = np.nan
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    pre = fe.FeaturePreprocessor(imputation, scaling, True).fit(df, ["a", "b"])
    got = np.array([[r["a"], r["b"]] for r in pre.transform(df).orderBy("id").collect()])
    for j in range(2):
        known = x[~np.isnan(x[:, j]), j]
        values, counts = np.unique(known, return_counts=True)
        fill = {"mean": known.mean(), "median": np.median(known), "most_frequent": values[counts.argmax()], "constant": 0.0}[imputation]
        x[np.isnan(x[:, j]), j] = fill
    if scaling == "standard":
        x = (x - x.mean(0)) / x.std(0)
    elif scaling == "robust":
        q1, q2, q3 = np.quantile(x, [.25, .5, .75], axis=0)
        x = (x - q2) / (q3 - q1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    np.testing.assert_allclose(got, x / np.where(norm == 0, 1, norm), atol=1e-12)


def test_transform_needs_fit(spark):
    with pytest.raises(ValueError):
        fe.FeaturePreprocessor().transform(spark.range(1))


def test_containment_by_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ab1") for _ in range(rnd.randint(1, 6)))
    targets, cands = sorted({f"t/{word()}.mp4" for _ in range(80)}), [f"c/{word()}.mp4" for _ in range(40)]
    got = {r["video_path"]: r["matched_path"] for r in fe.match_contained(
        spark.createDataFrame([(t,) for t in targets], "video_path string"),
        spark.createDataFrame(list(enumerate(cands)), "seq int, video_path string")).collect()}
    lookup = {}
    for c in cands:
        lookup[c[2:-4]] = c  # place of the first, path of the last
    for t in targets:
        want = next((p for k, p in lookup.items() if t[2:-4] in k or k in t[2:-4]), None)
        assert got.get(t) == want


def test_match_levels(spark):
    cands = spark.createDataFrame([(1, "c/AB_aug1.mp4"), (2, "c/xyz_long.mp4"), (3, "d/ab_aug1.mp4")], "seq int, video_path string")
    targets = spark.createDataFrame([("t/ab_aug1_scaled_aug1.mp4",), ("t/xyz.mp4",), ("t/qqq.mp4",)], "video_path string")
    plain = {r["video_path"]: (r["matched_path"], r["level"]) for r in fe.match_paths(targets, cands).collect()}
    assert plain == {"t/ab_aug1_scaled_aug1.mp4": ("d/ab_aug1.mp4", 1)}
    full = {r["video_path"]: (r["matched_path"], r["level"]) for r in fe.match_paths(targets, cands, contained=True).collect()}
    assert full == {**plain, "t/xyz.mp4": ("c/xyz_long.mp4", 2)}


def test_combined_stages_keep_only_complete_rows(spark):
    targets = spark.createDataFrame([("o/a.mp4", 1), ("o/b.mp4", 0), ("o/c.mp4", 1)], "video_path string, label int")
    s2 = spark.createDataFrame([("f/a.mp4", 1, 1.0), ("f/A.mp4", 2, 2.0), ("f/b.mp4", 3, None)], "video_path string, seq int, x double")
    s4 = spark.createDataFrame([("g/a_scaled_original.mp4", 1, 5.0), ("g/c.mp4", 2, 6.0)], "video_path string, seq int, y double")
    assert [tuple(r) for r in fe.combine_stages(targets, s2, s4).collect()] == [("o/a.mp4", 1, 2.0, 5.0)]
    only = {r["video_path"]: r["stage2_x"] for r in fe.combine_stages(targets, s2, None).collect()}
    assert only == {"o/a.mp4": 2.0, "o/b.mp4": 0.0}
    with pytest.raises(ValueError):
        fe.combine_stages(targets, None, None)


def test_lengths_follow_the_commonest(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],), ([4.0],), ([5.0, 6.0],)], "v array<double>")
    assert sorted(r["v"] for r in fe.equal_lengths(df, "v").collect()) == [[1.0, 2.0], [1.0, 2.0], [4.0, 0.0], [5.0, 6.0]]
    assert fe.modal_length(df.where(F.size("v") != 2), "v").head()["length"] == 1


def test_single_bad_values_do_not_cost_columns(spark):
    i = F.col("id")
    df = spark.range(100).select((i % 7 * 1e-6).alias("small"), F.when(i == 3, float("nan")).otherwise(i * 1.0).alias("nan"),
                                 F.when(i < 3, i * 2.0).alias("sparse"), F.lit(1.0).alias("constant"))
    fitted = fe.FeaturePruner(method="none").fit(df, df.columns)
    assert fitted.kept == ["small", "nan", "sparse"]
    assert fe.FeaturePruner().fit(df, df.columns).kept == ["small", "nan", "sparse"]


def test_dependent_columns_alone_are_infinite():
    x, y, z = np.random.default_rng(1).normal(size=(3, 200))
    factors = fe.inflation_factors(np.corrcoef([x, x, y, z]))
    assert np.isinf(factors[:2]).all() and (factors[2:] < 2).all()


def test_containment_equals_brute_force(spark):
    """Keys shorter and longer than a piece, hot pieces, one of 255 letters, and repeated letters."""
    draw = random.Random(3)
    words = ["ab", "abc", "customer", "0000", "x", "é", "long_shared_prefix_", "7"]
    hay = {"".join(draw.choice(words) for _ in range(draw.randint(1, 9))) for _ in range(150)} | {"q" * 255, "y" * 254 + "z"}
    needles = {"".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(150)} | {"q" * 255, "q" * 8, "q", "yz", ""}
    got = fe.containments(spark.createDataFrame([(n,) for n in needles], "needle string"),
                          spark.createDataFrame([(h, i) for i, h in enumerate(sorted(hay))], "hay string, place int"))
    rows = got.select("needle", "hay").collect()
    assert sorted((r["needle"], r["hay"]) for r in rows) == sorted((n, h) for n in needles for h in hay if n and n in h)


def test_index_rows_are_linear_in_key_length(spark):
    one = spark.createDataFrame([("".join(chr(97 + (i * i) % 26) + str(i) for i in range(255))[:255],)], "t string")
    assert one.select(F.size(fe._grams(F.col("t"), fe.GRAM)).alias("n")).head()["n"] <= 255 - fe.GRAM + 1


def test_contained_match_of_a_long_key(spark):
    long = "k" * 120 + "middle" + "w" * 129
    targets = spark.createDataFrame([(f"t/{long}.mp4",), ("t/middle.mp4",), ("t/nowhere.mp4",)], "video_path string")
    cands = spark.createDataFrame([("c/w.mp4", 3), (f"c/a{long}.mp4", 2), ("c/idd.mp4", 1)], "video_path string, seq long")
    got = {r["video_path"]: r["matched_path"] for r in fe.match_contained(targets, cands).collect()}
    assert got == {f"t/{long}.mp4": "c/idd.mp4", "t/middle.mp4": "c/idd.mp4", "t/nowhere.mp4": "c/w.mp4"}


def test_indexes_of_names_are_never_broadcast(spark):
    """Pieces of names are many times what the file of the names takes, so its size says nothing."""
    targets = spark.createDataFrame([("t/xCustomer#000000012y.mp4",), ("t/0012.mp4",), ("t/none.mp4",)], "video_path string")
    cands = spark.createDataFrame([(f"c/Customer#{i:09d}.mp4", i) for i in range(40)], "video_path string, seq long")
    for df in (fe.match_contained(targets, cands), fe.containments(
            targets.select(F.col("video_path").alias("needle")), cands.select(F.col("video_path").alias("hay"), "seq"))):
        nodes = [name for name, _ in plan_of(df)]
        assert "SortMergeJoin" in nodes and not [x for x in nodes if x.startswith("Broadcast")]
    got = {r["video_path"]: r["matched_path"] for r in fe.match_contained(targets, cands).collect()}
    assert got == {"t/xCustomer#000000012y.mp4": "c/Customer#000000012.mp4", "t/0012.mp4": "c/Customer#000000012.mp4"}


def test_least_hay_of_each_needle(spark):
    """One row a needle, short or long; candidates of equal places go by path."""
    draw = random.Random(5)
    hay = sorted({"".join(draw.choice(["ab", "c", "long_name_", "00"]) for _ in range(draw.randint(1, 6))) for _ in range(90)})
    needles = sorted({"".join(draw.choice(["ab", "c", "long_name_", "0"]) for _ in range(draw.randint(1, 3))) for _ in range(60)})
    place = {h: draw.randint(0, 9) for h in hay}
    got = fe.containments(spark.createDataFrame([(n,) for n in needles], "needle string"),
                          spark.createDataFrame(list(place.items()), "hay string, place int"), least="place").collect()
    want = {n: min(found) for n in needles if (found := [p for h, p in place.items() if n in h])}
    assert sorted((r["needle"], r["place"]) for r in got) == sorted(want.items())
    cands = [("c/xx_1.mp4", 3), ("c/xx_2.mp4", 1), ("c/yy_b.mp4", 2), ("c/yy_a.mp4", 2)]
    first = fe.match_contained(spark.createDataFrame([("t/xx.mp4",), ("t/yy.mp4",)], "video_path string"),
                               spark.createDataFrame(cands, "video_path string, seq int"))
    assert {r["video_path"]: r["matched_path"] for r in first.collect()} == {"t/xx.mp4": "c/xx_2.mp4", "t/yy.mp4": "c/yy_a.mp4"}
