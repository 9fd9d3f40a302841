"""Splits, samples, ranges, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.operators import merging as mg
from vidspark.operators import ranking as rk
from vidspark.operators import splits as s
from vidspark.plans.registry import query
from vidspark.plans.reports import rounded
from vidspark.plans.views import CORPUS, MANIFEST

_UNITS = """units AS (
  SELECT 'g:' || CAST(dup_group AS VARCHAR) AS unit, dup_group, arg_min(label || '__' || platform, video_id) AS stratum
  FROM corpus GROUP BY dup_group),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42-' || unit), unit) AS rn,
  count(*) OVER (PARTITION BY stratum) AS n FROM units)"""
_SPLIT = _UNITS + """, cut AS (SELECT *, round_even(n * 0.1::DOUBLE, 0) AS n_test, round_even(n * 0.2::DOUBLE, 0) AS n_val FROM ranked),
assigned AS (SELECT c.video_id, c.label, c.platform, c.dup_group,
  CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split
  FROM corpus c JOIN cut USING (dup_group))"""
_FOLD = _UNITS + """, folded AS (SELECT c.video_id, c.label, c.platform, c.dup_group, CAST((rn - 1) % 5 AS INTEGER) AS fold
  FROM corpus c JOIN ranked USING (dup_group))"""


@query("d1_train_val_test", f"WITH {CORPUS}, {_SPLIT} SELECT video_id, label, platform, dup_group, split FROM assigned")
def d1(spark, d):
    return s.train_val_test(t.corpus(spark, d), "video_id")


@query("d1_rowwise_split", f"""WITH {CORPUS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label, platform ORDER BY md5('42-r:' || video_id), video_id) AS rn,
         count(*) OVER (PARTITION BY label, platform) AS n FROM corpus),
cut AS (SELECT *, round_even(n * 0.1::DOUBLE, 0) AS n_test, round_even(n * 0.2::DOUBLE, 0) AS n_val FROM ranked)
SELECT label, platform, CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, CAST(sum(video_id) AS BIGINT) AS id_sum FROM cut GROUP BY 1, 2, 3""")
def d1b(spark, d):
    out = s.train_val_test(t.corpus(spark, d), "video_id", group=None)
    return out.groupBy("label", "platform", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("video_id").alias("id_sum"))


@query("d2_stratified_folds", f"WITH {CORPUS}, {_FOLD} SELECT video_id, label, platform, dup_group, fold FROM folded")
def d2(spark, d):
    return s.stratified_folds(t.corpus(spark, d), "video_id")


@query("d3_empty_fold_repair", """WITH rows_ AS (
  SELECT c_custkey AS video_id, n_name AS label, n_nationkey AS dup_group FROM customer JOIN nation ON c_nationkey = n_nationkey),
u AS (SELECT dup_group, row_number() OVER (ORDER BY label DESC) AS rn FROM (SELECT DISTINCT dup_group, label FROM rows_))
SELECT video_id, label, dup_group, CAST(CASE WHEN rn <= 3 THEN rn ELSE 0 END AS INTEGER) AS fold FROM rows_ JOIN u USING (dup_group)""")
def d3(spark, d):
    """One group of copies per stratum: all of them start in fold 0, and the empty folds take one each."""
    rows = t.load(spark, d, "customer").join(t.load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select(F.col("c_custkey").alias("video_id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("dup_group"))
    return s.stratified_folds(rows, "video_id", k=4, platform=None)


@query("d4_two_cut_split", """WITH r AS (
  SELECT o_orderkey AS id, o_orderstatus AS label,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42-' || o_orderkey), o_orderkey) AS rn,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
c AS (SELECT *, round_even(n * (0.2::DOUBLE + 0.2::DOUBLE), 0) AS n_rest FROM r),
e AS (SELECT *, round_even(n_rest * 0.5::DOUBLE, 0) AS n_test FROM c)
SELECT id, label, CASE WHEN rn <= n - n_rest THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split FROM e""")
def d4(spark, d):
    rows = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return s.two_cut_split(rows, "id")


_SAMPLE = """WITH r AS (
  SELECT o_orderkey AS id, o_orderstatus AS label,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42-' || o_orderkey), o_orderkey) AS rn,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT id, label, rn <= round_even(n * {share}::DOUBLE, 0) AS in_sample FROM r"""


@query("d5_search_sample", _SAMPLE.format(share="0.1"))
def d5(spark, d):
    rows = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return s.stratified_sample(rows, "id", fraction=s.search_fraction(0.1))


@query("d6_inner_holdout", _SAMPLE.format(share="0.2").replace(" AS in_sample FROM r", " AS is_holdout FROM r"))
def d6(spark, d):
    rows = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return s.stratified_sample(rows, "id", fraction=0.2).withColumnRenamed("in_sample", "is_holdout")


@query("d7_path_sample", f"""WITH {MANIFEST} SELECT video_path FROM manifest ORDER BY md5('42-' || video_path), video_path LIMIT 50""")
def d7(spark, d):
    return rk.shuffled_sample(t.manifest(spark, d).select("video_path"), "video_path", 50)


@query("d8_strata", f"""WITH {CORPUS} SELECT label || '__' || platform AS stratum, count(*) AS n FROM corpus GROUP BY 1""")
def d8(spark, d):
    return t.corpus(spark, d).groupBy(s.strata_key().alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("w2_running_frames", f"""WITH {MANIFEST}
SELECT doc_id, CAST(sum(coalesce(frame_count, 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
FROM manifest""")
def w2(spark, d):
    rows = t.manifest(spark, d).select("doc_id", "frame_count")
    return rk.running_totals(rows, {"running": F.coalesce("frame_count", F.lit(0))}, "doc_id").select("doc_id", "running")


@query("w3_capacity_ranges", f"""WITH {MANIFEST}, r AS (
  SELECT doc_id, CAST(sum(coalesce(frame_count, 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM manifest)
SELECT doc_id, running, CASE WHEN running <= 720000 THEN 0 WHEN running <= 1440000 THEN 1 WHEN running <= 3600000 THEN 2
  WHEN running <= 5760000 THEN 3 WHEN running <= 7920000 THEN 4 WHEN running <= 10080000 THEN 5
  WHEN running <= 12240000 THEN 6 WHEN running <= 14400000 THEN 7
  ELSE CAST(8 + (running - 14400001) // 2160000 AS INTEGER) END AS work_range FROM r""")
def w3(spark, d):
    return rk.capacity_ranges(t.manifest(spark, d).select("doc_id", "frame_count"), "doc_id", "frame_count") \
        .select("doc_id", "running", "work_range")


@query("w3_equal_ranges", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(idx // CAST(ceil(n / 8.0::DOUBLE) AS BIGINT) AS INTEGER) AS work_range FROM r""")
def w3b(spark, d):
    return rk.capacity_ranges(t.load(spark, d, "documents").select("doc_id"), "doc_id", None)


@query("w4_stratum_positions", f"""WITH {CORPUS}
SELECT video_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7-' || video_id), video_id) AS rn,
       count(*) OVER (PARTITION BY label) AS rn_total FROM corpus""")
def w4(spark, d):
    return rk.rank_by_hash(t.corpus(spark, d).select("video_id", "label"), ["label"], ["video_id"], 7)


@query("w5_balanced_batches", f"""WITH {MANIFEST}, r AS (
  SELECT video_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || video_id), video_id) AS rn
  FROM manifest WHERE label IN (0, 1)),
m AS (SELECT least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) AS smallest FROM manifest)
SELECT video_id, label, (rn - 1) // least(4, smallest) AS batch FROM r, m
WHERE (rn - 1) // least(4, smallest) < smallest // least(4, smallest)""")
def w5(spark, d):
    return s.balanced_batches(t.manifest(spark, d).select("video_id", "label"), "video_id")


@query("k5_first_per_class", f"""WITH {MANIFEST} SELECT doc_id, label FROM manifest WHERE label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 5""")
def k5(spark, d):
    return rk.first_per_class(t.manifest(spark, d).select("doc_id", "label"), "label", "doc_id", 5)


@query("k6_row_range", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, idx, idx - 1000 AS position FROM r WHERE idx >= 1000 AND idx < least(100000000, n)""")
def k6(spark, d):
    return rk.index_range(t.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 100000000)


@query("k6_row_range_reverse", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
SELECT o_orderkey, idx, 1199 - idx AS position FROM r WHERE idx >= 200 AND idx < 1200""")
def k6b(spark, d):
    return rk.index_range(t.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 200, 1200, reverse=True)


@query("k7_equal_parts", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(least(idx // (n // 3), 2) AS INTEGER) AS part FROM r""")
def k7(spark, d):
    return rk.equal_ranges(t.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3).select("o_orderkey", "part")


@query("k8_shuffled_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 100")
def k8(spark, d):
    return rk.shuffled_sample(t.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("m5_leaked_groups", f"""WITH {CORPUS}, {_SPLIT} SELECT count(*) AS leaked FROM (
  SELECT dup_group FROM assigned GROUP BY dup_group HAVING count(DISTINCT split) > 1)""")
def m5(spark, d):
    split = s.train_val_test(t.corpus(spark, d), "video_id")
    return mg.leaked_groups(split, "dup_group").agg(F.count(F.lit(1)).alias("leaked"))


@query("m6_fold_complement", f"""WITH {CORPUS}, {_FOLD} SELECT k.fold, count(*) FILTER (WHERE f.fold = k.fold) AS val_rows,
  count(*) FILTER (WHERE f.fold <> k.fold) AS train_rows FROM folded f, (SELECT DISTINCT fold FROM folded) k GROUP BY k.fold""")
def m6(spark, d):
    sizes = s.stratified_folds(t.corpus(spark, d), "video_id").groupBy("fold").agg(F.count(F.lit(1)).alias("val_rows"))
    return sizes.withColumn("train_rows", sizes.agg(F.sum("val_rows")).scalar() - F.col("val_rows"))


@query("m7_coverage", f"""WITH {CORPUS}, {_SPLIT} SELECT
  (SELECT count(*) FROM (SELECT video_id FROM corpus EXCEPT ALL SELECT video_id FROM assigned)) AS lost,
  (SELECT count(*) FROM (SELECT video_id FROM assigned EXCEPT ALL SELECT video_id FROM corpus)) AS added""")
def m7(spark, d):
    rows = t.corpus(spark, d)
    return mg.coverage(rows, s.train_val_test(rows, "video_id"), "video_id")


@query("a29_fold_balance", f"""WITH {CORPUS}, {_FOLD}, cells AS (SELECT fold, label, count(*) AS n FROM folded GROUP BY 1, 2),
c AS (SELECT label, sum(n) AS n FROM cells GROUP BY 1), f AS (SELECT fold, sum(n) AS n FROM cells GROUP BY 1),
g AS (SELECT f.fold, c.label, CAST(c.n - coalesce(cells.n, 0) AS BIGINT) AS train_count, CAST(coalesce(cells.n, 0) AS BIGINT) AS val_count,
        f.n AS fold_n, (SELECT sum(n) FROM cells) AS total
      FROM f CROSS JOIN c LEFT JOIN cells ON cells.fold = f.fold AND cells.label = c.label),
h AS (SELECT *, train_count::DOUBLE / (total - fold_n) AS ts, val_count::DOUBLE / fold_n AS vs FROM g)
SELECT fold, label, train_count, val_count, round(ts, 6) AS train_share, round(vs, 6) AS val_share,
       CASE WHEN train_count = 0 THEN 'missing in training' WHEN val_count = 0 THEN 'missing in validation'
            WHEN abs(ts - vs) > 0.2 THEN 'imbalanced' ELSE 'ok' END AS verdict FROM h""")
def a29(spark, d):
    return rounded(s.fold_balance(s.stratified_folds(t.corpus(spark, d), "video_id")))


@query("j17_weighted_draws", """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT *, sum(n / (n + 1e-6::DOUBLE)) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) / sum(n / (n + 1e-6::DOUBLE)) OVER () AS upto FROM c),
u AS (SELECT o_orderkey AS draw, CAST('0x' || substr(md5('42-class-' || o_orderkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u1,
  CAST('0x' || substr(md5('42-row-' || o_orderkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u2 FROM orders),
p AS (SELECT draw, u2, (SELECT min(label) FROM m WHERE u1 < upto) AS label FROM u),
q AS (SELECT draw, label, least(CAST(floor(u2 * n) AS BIGINT) + 1, n) AS rn FROM p JOIN c USING (label)),
r AS (SELECT o_orderkey AS video_id, o_orderstatus AS label,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42-rows-' || o_orderkey), o_orderkey) AS rn FROM orders)
SELECT draw, video_id, label FROM q JOIN r USING (label, rn)""")
def j17(spark, d):
    return s.weighted_draws(t.corpus(spark, d).select("video_id", "label"), "video_id")


@query("j17_row_weighted_draws", """WITH r AS (
  SELECT o_orderkey AS k, CAST(round(o_totalprice::DOUBLE * 100, 0) AS HUGEINT) AS w, md5('42-line-' || o_orderkey) AS h FROM orders),
line AS (SELECT k, CAST(sum(w) OVER (ORDER BY h, k ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM r WHERE w >= 1),
u AS (SELECT o_orderkey AS draw, CAST('0x' || substr(md5('42-place-' || o_orderkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
  * (SELECT max(upto) FROM line) AS place FROM orders)
SELECT draw, k AS video_id FROM u ASOF JOIN line ON place < upto""")
def j17b(spark, d):
    """Dear orders are drawn more often; nearly every row has a weight of its own."""
    rows = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), "o_totalprice")
    return s.row_weighted_draws(rows, "video_id", "o_totalprice", units=100)
