from collections import Counter

import pytest
from pyspark.sql import functions as F

from vidspark.operators import merging as mg
from vidspark.operators import ranking as rk
from vidspark.operators import splits as sp


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows in one group of copies, others in pairs or alone."""
    i = F.col("id")
    group = F.when(i % 3 == 0, F.lit(-1)).when(i % 3 == 1, (i / 6).cast("bigint"))
    return spark.range(3000).select(i.alias("video_id"), (i % 2).cast("int").alias("label"),
                                    F.concat(F.lit("p"), (i % 4).cast("string")).alias("platform"), group.alias("dup_group"))


def test_groups_stay_together_and_all_rows_are_kept(rows):
    out = sp.train_val_test(rows, "video_id")
    assert mg.leaked_groups(out, "dup_group").count() == 0
    assert out.count() == 3000 and out.select("video_id").distinct().count() == 3000


def test_row_split_sizes(rows):
    n = Counter(r["split"] for r in sp.train_val_test(rows, "video_id", group=None).collect())
    assert sum(n.values()) == 3000 and abs(n["val"] / 3000 - 0.2) < 0.01 and abs(n["test"] / 3000 - 0.1) < 0.01


def test_sizes_round_half_to_even(spark):
    df = spark.range(5).select(F.col("id").alias("video_id"), F.lit(0).alias("label"))
    n = Counter(r["split"] for r in sp.train_val_test(df, "video_id", platform=None, group=None).collect())
    assert n == {"train": 4, "val": 1}  # 0.5 rounds to 0, 1.0 to 1


def test_folds_partition_rows(rows):
    out = sp.stratified_folds(rows, "video_id", k=5).collect()
    assert len(out) == 3000 and {r["fold"] for r in out} == set(range(5))
    by_group = {}
    for r in out:
        if r["dup_group"] is not None:
            by_group.setdefault(r["dup_group"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in by_group.values())


def test_same_split_on_any_partitioning(rows):
    a = {r["video_id"]: r["fold"] for r in sp.stratified_folds(rows, "video_id").collect()}
    b = {r["video_id"]: r["fold"] for r in sp.stratified_folds(rows.repartition(13), "video_id").collect()}
    assert a == b


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (6, 10), (10, 10), (2, 2)])
def test_empty_folds_are_filled(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("video_id"), F.col("id").cast("string").alias("label"))
    folds = Counter(r["fold"] for r in sp.stratified_folds(df, "video_id", k=k, platform=None, group=None).collect())
    assert sum(folds.values()) == n and len(folds) == min(n, k)


def test_two_cut_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    n = Counter((r["label"], r["split"]) for r in sp.two_cut_split(df, "id").collect())
    assert n == {(0, "train"): 450, (0, "val"): 150, (0, "test"): 150, (1, "train"): 150, (1, "val"): 50, (1, "test"): 50}
    with pytest.raises(ValueError):
        sp.two_cut_split(df, "id", train=0.5)


def test_balanced_batches(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = Counter((r["batch"], r["label"]) for r in sp.balanced_batches(df, "id", batch_size=8).collect())
    assert set(out.values()) == {4} and len(out) == 2 * (35 // 4)
    tiny = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label int")
    assert sp.balanced_batches(tiny, "id", batch_size=16).count() == 2
    with pytest.raises(ValueError):
        sp.balanced_batches(tiny, "id", batch_size=3)


def test_draws_follow_class_weights(spark):
    df = spark.range(4000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    out = sp.weighted_draws(df, "id").collect()
    share = sum(r["label"] for r in out) / len(out)
    assert len(out) == 4000 and abs(share - 0.5) < 0.03
    assert all((r["id"] % 10 == 0) == (r["label"] == 1) for r in out)


def test_running_totals_with_ties_in_buckets(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 11).alias("v"),
                                  F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit(None)).alias("g"))
    out = rk.running_totals(df, {"s": F.col("v")}, "k", ["g"], totals=True).collect()
    assert len(out) == 5000
    for g in ("hot", None):
        part = sorted((r for r in out if r["g"] == g), key=lambda r: r["k"])
        total = 0
        for r in part:
            total += r["v"]
            assert r["s"] == total
        assert all(r["s_total"] == total for r in part)
    down = rk.running_totals(df, {"s": F.col("v")}, "k", descending=True).orderBy("k").collect()
    assert down[0]["s"] == sum(r["v"] for r in out) and down[-1]["s"] == down[-1]["v"]


def test_row_ranges(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("k"))
    assert [r["k"] for r in rk.index_range(df, "k", -5, 4).orderBy("position").collect()] == [0, 3, 6, 9]
    assert [r["k"] for r in rk.index_range(df, "k", 97, 500, reverse=True).orderBy("position").collect()] == [297, 294, 291]
    parts = Counter(r["part"] for r in rk.equal_ranges(df, "k", 3).collect())
    assert parts == {0: 33, 1: 33, 2: 34}


def test_capacity_ranges(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 1), (5, 100)], "k long, w long")
    got = {r["k"]: r["work_range"] for r in rk.capacity_ranges(df, "k", "w", [5, 10, 20]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 12}  # 111 lies in the tenth range of ten beyond 20


def test_samples_and_limits(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("label"))
    assert rk.shuffled_sample(df, "id", 50).count() == 50
    assert {r["id"] for r in rk.first_per_class(df, "label", "id", 7).collect()} == set(range(21))
    named = df.withColumn("name", F.format_string("%05d", "id"))
    assert {r["id"] for r in rk.first_per_class(named, "label", "name", 120).collect()} == set(range(360))


def test_rows_without_keys_stay_in_the_split(spark):
    df = spark.createDataFrame([(None, "a", None, None), (1, None, "a", None), (2, "a", None, None)],
                               "video_id long, label string, platform string, dup_group long")
    assert sp.train_val_test(df, "video_id").count() == 3
    assert df.select(sp.strata_key()).distinct().count() == 2
    with pytest.raises(ValueError):
        sp.stratified_sample(df, "video_id", fraction=1.5)


def walk(plan):
    """Names and texts of the nodes that rows pass, subqueries left out."""
    kids = plan.children()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return walk(plan.initialPlan())
    return [(plan.nodeName(), plan.simpleString(200))] + [x for i in range(kids.size()) for x in walk(kids.apply(i))]


def plan_of(df):
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("n", [0, 1, 10, 2500, 4999, 5000, 9000])
def test_shuffled_sample_is_exact(spark, n):
    df = spark.range(5000).select((F.col("id") * 3).alias("key"), F.lit("x").alias("_bucket_of"))
    ranked = rk.rank_by_hash(df.withColumn("g", F.lit(0)), ["g"], ["key"]).where(F.col("rn") <= n)
    got = sorted(r["key"] for r in rk.shuffled_sample(df, "key", n).collect())
    assert got == sorted(r["key"] for r in ranked.collect()) and len(got) == min(n, 5000)


def test_shuffled_sample_with_equal_and_missing_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(5)], "key long, v int")
    assert [rk.shuffled_sample(df, "key", n).count() for n in (0, 3, 7, 10, 11)] == [0, 3, 7, 10, 10]
    assert rk.shuffled_sample(df.where("false"), "key", 3).count() == 0


def test_only_the_cut_is_exchanged(spark):
    """One branch has no exchange, the other filters by the cut below its exchange."""
    plan = plan_of(rk.shuffled_sample(spark.range(100).withColumnRenamed("id", "key"), "key", 10))
    exchanges = [i for i, (name, _) in enumerate(plan) if name == "Exchange"]
    assert len(exchanges) == 1
    after = plan[exchanges[0]:]
    assert any(name == "Filter" and " = Subquery" in text for name, text in after)


@pytest.mark.parametrize("kind", ["bigint", "string", "double", "date"])
def test_order_index_of_any_type(spark, kind):
    values = [(i * 7919) % 4001 for i in range(4001)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    col = {"bigint": F.col("v"), "string": F.concat(F.lit("same/long/prefix/"), F.col("v").cast("string")),
           "double": F.col("v") / 3.0, "date": F.date_add(F.lit("2000-01-01"), F.col("v").cast("int"))}[kind]
    out = rk.order_index(df.select(col.alias("c"), "v"), "c").collect()
    assert [r["idx"] for r in sorted(out, key=lambda r: r["c"])] == list(range(4001))


def test_splitters_are_even_and_bounded(spark):
    df = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("c"))
    cuts = rk.value_splitters(df, "c", 256)
    assert 200 <= len(cuts) <= 600
    sizes = [r["count"] for r in df.select(rk.splitter_bucket("c", cuts).alias("b")).groupBy("b").count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 200_000 / 256 * 4
    assert rk.value_splitters(df.where("false"), "c") == []


@pytest.mark.parametrize("sent", [10_000, 0])
@pytest.mark.parametrize("k", [0, 1, 300, 4000, 9000])
def test_first_per_class_with_a_hot_class(spark, monkeypatch, sent, k):
    monkeypatch.setattr(rk, "SENT_CLASSES", sent)
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, F.col("id").cast("string")).alias("label"),
                                  F.format_string("%06d", (F.col("id") * 7) % 5003).alias("name"), "id")
    rows = {}
    for r in df.collect():
        if r["label"] is not None:
            rows.setdefault(r["label"], []).append((r["name"], r["id"]))
    want = sorted((x, *y) for x, ys in rows.items() for y in sorted(ys)[:k])
    got = sorted((r["label"], r["name"], r["id"]) for r in rk.first_per_class(df, "label", "name", k).collect())
    assert got == want


def test_label_index_of_a_million_labels(spark):
    from vidspark.operators.models import label_index
    df = spark.range(1_000_000).select(F.concat(F.lit("l"), F.format_string("%07d", (F.col("id") * 999_983) % 1_000_000)).alias("label"),
                                       ((F.col("id") * 999_983) % 1_000_000).alias("want"))
    out = label_index(df.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS label, CAST(NULL AS BIGINT) AS want")), "label")
    assert out.where("NOT (label_idx <=> want)").count() == 0
    assert out.count() == 1_000_001
    plan = plan_of(out)  # one task sees the sizes of the ranges, never the labels
    assert all(plan[i + 1][0] == "HashAggregate" for i, (name, text) in enumerate(plan) if "SinglePartition" in text)


def test_row_weighted_draws(spark):
    """A row of a third of all weight, rows that cannot be drawn, equal and missing keys."""
    df = spark.range(20_000).select("id", F.when(F.col("id") == 7, 10_000.0).when(F.col("id") % 10 == 0, F.lit(-1.0))
                                    .when(F.col("id") % 10 == 1, F.lit(None)).when(F.col("id") % 10 == 2, float("nan"))
                                    .when(F.col("id") % 10 == 3, 0.0).when(F.col("id") % 10 == 4, 8.0).otherwise(1.0).alias("w"))
    out = sp.row_weighted_draws(df, "id", "w").collect()
    assert sorted(r["draw"] for r in out) == list(range(20_000))
    drawn = Counter(r["id"] % 10 if r["id"] != 7 else "hot" for r in out)
    assert not {0, 1, 2, 3} & set(drawn)
    total = 10_000 + 2_000 * 8 + 5 * 2_000 - 1
    assert abs(drawn["hot"] / 20_000 - 10_000 / total) < 0.015 and abs(drawn[4] / 20_000 - 16_000 / total) < 0.015
    again = sp.row_weighted_draws(df.repartition(13), "id", "w").collect()
    assert sorted((r["draw"], r["id"]) for r in again) == sorted((r["draw"], r["id"]) for r in out)
    none = df.withColumn("w", F.lit(0.0))
    assert sp.row_weighted_draws(none, "id", "w").count() == 0
    same = spark.createDataFrame([(None, 1.0), (None, 3.0), (5, 2.0)], "id long, w double")
    assert sp.row_weighted_draws(same, "id", "w").count() == 3
