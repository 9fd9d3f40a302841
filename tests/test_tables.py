"""Sinks, readers, merges and checks."""

import pytest
from pyspark.sql import functions as F

from vidspark.operators import merging as mg
from vidspark.operators import models as mo
from vidspark.operators import quality as q
from vidspark.operators import results as r
from vidspark.session import scratch_path, shared_dir
from vidspark.sources import readers as rd
from vidspark.sources import sinks as sk
from vidspark.streaming.metrics_log import ingest_new


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_append_keeps_newest_rows(spark):
    path = scratch_path(spark, "t")
    sk.write_metadata(spark.createDataFrame([("a", 1), ("b", 1)], "video_path string, v int"), path)
    sk.write_metadata(spark.createDataFrame([("b", 2), ("c", 2)], "video_path string, v int"), path, append=True)
    assert {tuple(x) for x in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    sk.write_metadata(spark.createDataFrame([("z", 9)], "video_path string, v int"), path)
    assert [tuple(x) for x in spark.read.parquet(path).collect()] == [("z", 9)]


def test_two_ways_of_merging(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {tuple(x) for x in mg.merge_keep(old, new, ["k"], "existing").collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert {tuple(x) for x in mg.merge_keep(old, new, ["k"], "latest").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    with pytest.raises(ValueError):
        mg.merge_keep(old, new, ["k"], "other")


def test_label_column_is_required(spark):
    path = scratch_path(spark, "csv")
    spark.range(3).write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        rd.read_csv(spark, path)


def test_copies_need_not_exist(spark):
    assert rd.load_duplicates(spark, shared_dir(spark), "no-such-file.csv").count() == 0
    with pytest.raises(FileNotFoundError):
        rd.load_main_metadata(spark, scratch_path(spark, "void"))
    assert rd.read_table(spark, scratch_path(spark, "void"), "x") is None


def test_stream_takes_each_file_once(spark):
    base = scratch_path(spark, "stream")
    rows = spark.range(10).select(F.lit("r").alias("run_id"), F.col("id").alias("step"), F.lit(1).alias("epoch"), F.lit("val").alias("phase"),
                                  F.lit("loss").alias("metric"), F.col("id").cast("double").alias("value"))
    for _ in range(2):
        sk.append_metrics(rows, f"{base}/log")
        ingest_new(spark, f"{base}/log", f"{base}/table", f"{base}/state")
        ingest_new(spark, f"{base}/log", f"{base}/table", f"{base}/state")
    assert spark.read.parquet(f"{base}/table").count() == 20


def test_index_and_null_groups(spark):
    scan = spark.createDataFrame([(str(i), f"videos/{i}", None, "yt") for i in range(6)], "video_id string, video_path string, subset string, platform string")
    main = spark.createDataFrame([("0", 1, "s", "x"), ("1", 0, "s", "x"), ("2", 1, "s", "x")], "video_id string, label int, subset string, platform string")
    dup = spark.createDataFrame([("0", "g", 0, "d"), ("1", "g", 0, "d"), ("3", None, 1, "d"), ("3", None, 1, "d")], "video_id string, dup_group string, label int, platform string")
    everything = q.video_index(scan, main, dup)
    assert sorted(x["video_id"] for x in everything.collect()) == ["0", "1", "2", "3", "3"]
    assert sorted(x["video_id"] for x in q.video_index(scan, main, dup, drop_duplicates=True).collect()) == ["0", "2", "3", "3"]
    assert {x["platform"] for x in everything.collect()} == {"yt"} and everything.columns[:2] == ["subset", "platform"]
    one_null = q.video_index(scan, main, dup, drop_duplicates=True, null_is_group=True)
    assert [x["video_id"] for x in one_null.collect()] in (["0", "2"], ["2", "0"])


def test_table_checks(spark):
    df = spark.createDataFrame([("a", 1)], "video_path string, label int")
    assert q.check_table(df, ["video_path"]).head()["is_valid"]
    assert q.check_table(df.where("label = 5"), ["video_path"]).head()["message"] == "table is empty"
    assert not q.check_table(df, ["video_path"], min_rows=2).head()["is_valid"]
    assert not q.check_table(df, [], max_rows=0).head()["is_valid"]
    assert "x" in q.check_table(df, ["x"]).head()["message"]
    assert q.check_columns(df, ["label"]) and not q.check_columns(df, ["no"]) and not q.check_columns(df.limit(0), ["label"])


def test_contract(spark):
    df = spark.createDataFrame([("a", "1"), (None, "x")], "video_path string, label string")
    state = {x["column"]: (x["state"], x["violations"]) for x in q.check_contract(df, "stage5").collect()}
    assert state == {"video_path": ("present", 1), "label": ("present", 1)}


def test_grids():
    assert len(mo.parameter_grid("svm_stage2_stage4")) == 3
    with pytest.raises(ValueError):
        mo.parameter_grid("unknown")


def test_linear_grid_has_28_entries(spark):
    grid = spark.createDataFrame([(mo.LINEAR_GRID["C"], mo.LINEAR_GRID["penalty"], mo.LINEAR_GRID["solver"], [1000], mo.LINEAR_GRID["l1_ratio"])],
                                 "v1 array<double>, v2 array<string>, v3 array<string>, v4 array<int>, v5 array<double>")
    combos = r.parameter_combinations(grid, {"C": "v1", "penalty": "v2", "solver": "v3", "max_iter": "v4", "l1_ratio": "v5"})
    assert combos.count() == 72 and r.clean_linear_grid(combos).count() == 28


def test_best_of_a_search(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", 0.9), ("d", 0.9)], "p string, mean_f1 double")
    assert r.best_parameters(df, ["p"]).head()["p"] == "c"
    assert r.best_parameters(df.where("p = 'b'"), ["p"]).count() == 0
    folds = spark.createDataFrame([("m", 0, float("nan")), ("m", 1, 0.3), ("m", 2, 0.3)], "model string, fold int, val_f1 double")
    assert r.best_fold(folds).head()["best_fold"] == 1


def test_models_separate_separable_rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 4 + F.col("id") % 7 / 10).alias("x"),
                                 (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    for kind, own in (("logistic_regression", {"max_iter": 10}), ("svm", {"max_iter": 10}),
                      ("gradient_boosting", {"n_estimators": 3})):
        preds = mo.cross_validate(df, kind, ["x", "y"], "id", k=3, **own)
        out = mo.fold_metrics(preds).collect()
        assert len(out) == 3 and all(x["val_acc"] == 1.0 for x in out)
        assert preds.count() == 400


def test_learners_refuse_what_they_would_ignore(spark):
    with pytest.raises(ValueError):
        mo.make_classifier("svm", 10, 2, kernel="rbf")
    with pytest.raises(ValueError):
        mo.make_classifier("feature_mlp", 10, 2, weight="w")
    df = spark.range(6).select("id", F.lit(1).alias("label"), F.lit(1.0).alias("x"), F.lit(7).alias("fold"))
    with pytest.raises(ValueError):
        mo.cross_validate(df, "svm", ["x"], "id", k=3)


def test_the_latest_row_wins_alike_in_every_run(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "d"), (1, "c"), (2, "e")], "k long, v string")
    assert {tuple(x) for x in mg.merge_keep(old, new, ["k"], "latest").collect()} == {(1, "c"), (2, "e")}
