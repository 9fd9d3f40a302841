"""Resumed work, merged tables, observed counts, sampled decisions, streamed hashes, stored ML stages."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from test_splits import plan_of

from vidspark.operators import models as mo
from vidspark.operators import quality as q
from vidspark.operators import results as rs
from vidspark.operators.stages import FeatureClassifier, FeaturePreparer, FeatureSelector, feature_pipeline
from vidspark.plans.sources import x13b
from vidspark.session import shared_dir
from vidspark.sources import listing, sinks
from vidspark.sources.finished import FinishedWork
from vidspark.sources.merged import Conflict, MergedTable


@pytest.fixture
def work(spark, tmp_path):
    table = FinishedWork(spark, f"{tmp_path}/done", "clip STRING, idx INT, ok BOOLEAN", ["clip", "idx"], buckets=5)
    yield table
    table.forget()


def clips(spark, n):
    return spark.range(n).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 40).cast("string")).alias("clip"),
                                 F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("int")).alias("idx"), (F.col("id") % 2 == 0).alias("ok"))


def test_finished_keys_are_never_exchanged(spark, work):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        work.add(clips(spark, 50))
        work.add(clips(spark, 90).where("idx > 5"))
        rows = clips(spark, 2000)
        for df in (work.missing(rows.select("clip", "idx")), work.marked(rows, "done"), work.lacking(rows, 2),
                   work.known_or(rows, ["ok"], lambda x: x)):
            plan = plan_of(df)
            scans = [i for i, (name, text) in enumerate(plan) if "Scan parquet" in name]
            assert scans and all("Exchange" not in plan[j][0] for i in scans for j in range(i - 1, i - 6, -1)
                                 if "Join" not in plan[j][0] and "Union" not in plan[j][0])
            assert sum(name == "Exchange" for name, _ in plan) == sum("Join" in name for name, _ in plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_finished_work_with_missing_parts_and_repeats(spark, work):
    work.add(clips(spark, 60))
    work.add(clips(spark, 60))
    rows = clips(spark, 500)
    keys = lambda df: sorted((r["clip"] or "-", -1 if r["idx"] is None else r["idx"]) for r in df.collect())
    done = {(r["clip"], r["idx"]) for r in clips(spark, 60).collect()}
    want = sorted((r["clip"] or "-", -1 if r["idx"] is None else r["idx"]) for r in rows.collect() if (r["clip"], r["idx"]) not in done)
    assert keys(work.missing(rows)) == want
    marked = work.marked(rows, "done").collect()
    assert len(marked) == 500 and all(r["done"] == ((r["clip"], r["idx"]) in done) for r in marked)
    assert work.lacking(rows, 1).count() == len(want)
    assert work.known_or(rows, ["ok"], lambda x: x).where("from_cache").count() == 500 - len(want)
    assert work.missing(rows.where("false")).count() == 0


def files(path):
    import glob
    return set(glob.glob(f"{path}/gen=*/**/*.parquet", recursive=True))


def test_merge_rewrites_only_touched_parts(spark, tmp_path):
    table = MergedTable(spark, f"{tmp_path}/t", ["k"], parts=16)
    with pytest.raises(FileNotFoundError):
        table.read()
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert table.merge(base) == 1
    before, parts = files(table.path), table.state()[1]["parts"]
    assert table.merge(spark.createDataFrame([(5, "b"), (5, "a"), (2000, "n")], "k long, v string")) == 2
    after = table.state()[1]["parts"]
    assert before <= files(table.path) and sum(parts[p] != after[p] for p in parts) <= 2
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 1001 and got[5] in "ab" and got[2000] == "n" and got[6] == "a"
    assert table.read(1).count() == 1000
    assert table.merge(base.where("false")) == 2  # nothing to do: no version
    assert table.merge(spark.createDataFrame([(6, "c", 1)], "k long, v string, extra int")) == 3
    row = {r["k"]: r for r in table.read().collect()}
    assert row[6]["extra"] == 1 and row[7]["extra"] is None


def test_second_writer_of_a_version_fails(spark, tmp_path):
    table = MergedTable(spark, f"{tmp_path}/t", ["k"], parts=4)
    table.merge(spark.range(10).select(F.col("id").alias("k")))
    number, said = table.state()
    table._put_out(number + 1, said)
    with pytest.raises(Conflict):
        table._put_out(number + 1, said)


def test_counts_of_dropped_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, 2), (None, None), (3, 4)], "a int, b int")
    kept, counts = q.complete_rows(df, ["a", "b"])
    assert plan_of(kept)[1:].count("Exchange") == 0
    kept.write.parquet(f"{tmp_path}/kept")
    assert q.told(counts, ["n_rows", "no_a", "no_b"]) == {"n_rows": 4, "no_a": 2, "no_b": 1}
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 1


@pytest.mark.parametrize("bad,by", [(100, "sample"), (2, "sample"), (10, "all")])
def test_decision_on_a_sample(spark, bad, by):
    seen = []

    def validate(rows):
        seen.append(rows.count())
        return rows.withColumn("is_valid", F.col("id") % bad != 0)

    row = rs.sampled_validity(spark.range(5000), "id", validate, 300, required=4000).head()
    assert row["decided_by"] == by and row["n_rows"] == 5000
    assert seen == ([300] if by == "sample" else [300, 5000])
    assert row["keep_all"] == (bad >= 10) and row["enough"] == (bad >= 10)
    assert row["lower"] <= row["valid_rate"] <= row["upper"] and abs(row["estimated"] - 5000 * (1 - 1 / bad)) < 400


def test_decision_without_rows_or_with_a_whole_sample(spark):
    none = rs.sampled_validity(spark.range(0), "id", lambda x: x.withColumn("is_valid", F.lit(True)), 10).head()
    assert (none["checked"], none["decided_by"], none["keep_all"]) == (0, "all", False)
    all_of = rs.sampled_validity(spark.range(8), "id", lambda x: x.withColumn("is_valid", F.lit(True)), 10).head()
    assert (all_of["checked"], all_of["decided_by"], all_of["keep_all"], all_of["lower"]) == (8, "all", True, 1.0)


def test_hashes_of_files_above_a_piece(spark, tmp_path):
    contents = {"a.bin": b"", "b c.bin": b"x" * 10_000, "sub/c%20.gz": bytes(range(256)) * 5000}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # no row may hold a file
    try:
        rows = listing.file_hashes(spark, str(tmp_path), chunk=999).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r["name"]: (r["length"], r["sha256"]) for r in rows} == {
        n.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}  # Spark lists no empty file


def test_hashes_of_many_folders_take_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.bin").write_bytes(b"%d" % i)
    for hidden in ("_SUCCESS", ".f.crc", "d1/_temporary", "d2/f._COPYING_"):
        (tmp_path / hidden).write_bytes(b"x")
    spark.sparkContext.setJobGroup("hashes of files", "")
    try:
        rows = listing.file_hashes(spark, str(tmp_path)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["path"], r["length"], r["sha256"]) for r in rows} == {
        (f"file:{tmp_path}/d{i}/f.bin", len(str(i)), hashlib.sha256(b"%d" % i).hexdigest()) for i in range(400)}
    seen = spark.sparkContext.statusTracker()
    stages = {k for j in seen.getJobIdsForGroup("hashes of files") for k in seen.getJobInfo(j).stageIds}
    assert sum(x.numTasks for x in map(seen.getStageInfo, stages) if x) < 200  # a task a folder before


def test_a_file_per_key(spark, tmp_path):
    rows = [(f"k{i}", f"text {i}\nof two lines") for i in range(50)] + [("k7", "again"), ("a/b c", ""), ("", "e"), (None, "n"), ("u", None)]
    df = spark.createDataFrame(rows, "clip string, value string").repartition(5)
    sinks.write_files(df, str(tmp_path / "out"), "clip", "value")
    got = {p.name: sorted(p.read_text().splitlines()) for p in (tmp_path / "out").rglob("*") if p.is_file()}
    want = {f"clip=k{i}.txt": sorted(["again"] * (i == 7) + [f"text {i}", "of two lines"]) for i in range(50)}
    assert got == want | {"clip=a%2Fb%20c.txt": [""], "clip=__HIVE_DEFAULT_PARTITION__.txt": ["e", "n"], "clip=u.txt": [""]}
    folders = [p for p in (tmp_path / "out").rglob("*") if p.is_dir()]
    assert 0 < len(folders) < 20  # one a task
    sinks.write_files(df.where("false"), str(tmp_path / "none"), "clip", "value")
    assert listing.file_hashes(spark, str(tmp_path / "none")).count() == 0


def test_written_texts_make_no_folder_each(spark, tmp_path):
    """Texts whose id repeats share a file; the others have one each, without folders or checksums beside them."""
    rows = [(i, f"text {i}") for i in range(60)] + [(3, "text 3"), (60, None), (None, "n"), (61, "a\rb")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(shared_dir(spark)))
    got = {r["clip"]: (r["sha256"], r["length"]) for r in x13b(spark, str(tmp_path)).collect()}
    texts = {f"v{i}": f"text {i}\n" * (1 + (i == 3)) for i in range(60)} | {"v60": "\n", "__HIVE_DEFAULT_PARTITION__": "n\n"}
    assert got == {k: (hashlib.sha256(x.encode()).hexdigest(), len(x)) for k, x in texts.items()}
    written = [x for x in set(os.listdir(shared_dir(spark))) - before if x.startswith("x13-")]
    inside = [x for d in written for x in os.walk(os.path.join(shared_dir(spark), d))]
    assert sum(len(files) for _, _, files in inside) == 62 and len(inside) < 30


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(600) > 0).astype(int)
    rows = [(i, int(y[i]), i % 3, float(a), float(b) if i % 9 else None, float(c), float(a) * 2, 1.0,
             float(a) if i % 3 else float(c)) for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label int, fold int, a double, b double, c double, a2 double, one double, mixed double").cache()


COLUMNS = ["a", "b", "c", "a2", "one", "mixed"]


@pytest.mark.parametrize("kind", ["logistic_regression", "svm", "gradient_boosting", "feature_mlp"])
def test_stored_pipelines_score_alike(spark, tmp_path, features, kind):
    short = {"max_iter": 5} if kind != "gradient_boosting" else {"n_estimators": 2}
    fitted = feature_pipeline(kind, COLUMNS, **short).fit(features)
    mo.save_model(fitted, f"{tmp_path}/m")
    loaded = mo.load_model(f"{tmp_path}/m")
    one, two = (mo.predictions(m, features, "id").orderBy("id").collect() for m in (fitted, loaded))
    assert one == two and len(one) == 600
    assert loaded.stages[0].getOrDefault("kept") == ["b", "c", "a2", "mixed"]
    assert loaded.stages[1].getInputCols() == ["b", "c", "a2", "mixed"]


@pytest.mark.parametrize("kind", ["logistic_regression", "svm"])
def test_linear_models_score_in_a_session_that_has_observed_a_table(spark, features, kind):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(7).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 7}
    rows = features.select("id", "label", "fold", "a", "c")
    plain = mo.model_pipeline(kind, ["a", "c"], 600, max_iter=5).fit(rows)
    pooled = mo.cross_validate(rows, kind, ["a", "c"], "id", k=3, stored=True, max_iter=5)
    for preds in (mo.predictions(plain, rows, "id"), pooled):
        assert preds.where("y_pred = y_true").count() > 480 and preds.count() == 600
    base = mo.predictions(plain, rows, "id").selectExpr("id", "y_true", "p1", "'m' AS model")
    _, stacked = mo.stacked(base, "id", ["m"], F.col("id") % 2 == 0)
    assert len(stacked.collect()) == 300


def test_unfitted_pipelines_are_stored_too(spark, tmp_path):
    stages = Pipeline(stages=[FeatureSelector(inputCols=["a"], method="vif", vifThreshold=3.0),
                              FeaturePreparer(inputCols=["a"], scaling="none", normalize=False), FeatureClassifier(kind="svm", C=2.0)])
    stages.write().save(f"{tmp_path}/p")
    one, two, three = Pipeline.load(f"{tmp_path}/p").getStages()
    assert (one.getOrDefault("method"), one.getOrDefault("vifThreshold"), two.getOrDefault("scaling"), three.getOrDefault("C")) \
        == ("vif", 3.0, "none", 2.0)


def test_prepared_columns_equal_the_preprocessor(spark, features):
    from vidspark.operators.features import FeaturePreprocessor
    for settings in ({}, {"imputation": "median", "scaling": "robust"}, {"imputation": "most_frequent", "normalize": False},
                     {"imputation": "constant", "constant": 3.0}):
        stage = FeaturePreparer(inputCols=["a", "b"], **settings).fit(features).transform(features)
        plain = FeaturePreprocessor(**settings).fit(features, ["a", "b"]).transform(features)
        assert stage.select("id", "a", "b").orderBy("id").collect() == plain.select("id", "a", "b").orderBy("id").collect()
        assert stage.where(F.size(vector_to_array("features")) != 2).count() == 0


def test_every_fold_prunes_and_scales_for_itself(spark, features):
    """In the rows outside fold 0 ``mixed`` is ``a``, so it goes there and stays elsewhere."""
    fitted = mo._scored_entries(features, "logistic_regression", ["a", "c", "mixed"], [{"max_iter": 5}], "label", 3, "fold", 2)
    kept = [models[0].stages[0].getOrDefault("kept") for models in fitted.subModels]
    assert len(kept[0]) == 2 and len(kept[1]) == 3 and len(kept[2]) == 3
    centers = [tuple(models[0].stages[1].getOrDefault("center")) for models in fitted.subModels]
    assert len(set(centers)) == 3


def test_search_over_folds(spark, features):
    grid = [{"C": 1e-6, "max_iter": 20}, {"C": 1.0, "max_iter": 20}, {"C": 1.0, "max_iter": 20}]
    best, scores, preds = mo.grid_search(features, "logistic_regression", COLUMNS, "id", grid, k=3)
    assert best == 1 and scores[1] == scores[2] > 0.8
    assert preds.groupBy("entry").agg(F.countDistinct("id").alias("n"), F.count("*").alias("m")).where("n <> 600 OR m <> 600").count() == 0
    from vidspark.operators.metrics import basic_metrics
    again = basic_metrics(preds, groups=["entry", "fold"]).groupBy("entry").agg(F.avg("f1").alias("f")).orderBy("entry").collect()
    assert np.allclose([r["f"] for r in again], scores)
    with pytest.raises(ValueError):
        mo.grid_search(features, "svm", COLUMNS, "id", [{"hidden": 3}], k=3)
    with pytest.raises(ValueError):
        mo.cross_validate(features, "svm", COLUMNS, "id", k=2)
