"""Feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.operators import features as fe
from vidspark.operators import splits as sp
from vidspark.plans.registry import query
from vidspark.plans.reports import rounded
from vidspark.plans.views import STAGE2, STAGE4, TARGETS


@query("a9_clip_means", """SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 8) AS l_extendedprice,
  round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY l_orderkey""")
def a9(spark, d):
    out = fe.clip_means(t.load(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 8),
                            "l_discount": F.round("l_discount", 6)})


@query("a27_correlations", """SELECT 'l_quantity' AS feature_1, 'l_extendedprice' AS feature_2, round(corr(l_quantity, l_extendedprice), 6) + 0.0::DOUBLE AS correlation FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) + 0.0::DOUBLE FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) + 0.0::DOUBLE FROM lineitem""")
def a27(spark, d):
    return rounded(fe.correlation_pairs(t.load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("a28_variances", """SELECT 'l_quantity' AS feature, round(var_pop(l_quantity), 4) AS variance FROM lineitem
UNION ALL SELECT 'l_discount', round(var_pop(l_discount), 4) FROM lineitem UNION ALL SELECT 'l_tax', round(var_pop(l_tax), 4) FROM lineitem""")
def a28(spark, d):
    return rounded(fe.population_variances(t.load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 4)


@query("a32_modal_length", """SELECT CAST(len AS INTEGER) AS length FROM (SELECT least(64, 40 + vec_id % 30) AS len, count(*) AS n FROM embeddings GROUP BY 1)
ORDER BY n DESC, len LIMIT 1""")
def a32(spark, d):
    cut = F.slice("embedding", F.lit(1), (F.lit(40) + F.col("vec_id") % 30).cast("int"))
    return fe.modal_length(t.load(spark, d, "embeddings").select(cut.alias("v")), "v")


@query("j9_last_of_equal_keys", """SELECT 'c/u' || user_id || '_aug2_scaled_aug2.mp4' AS video_path, max(event_id) AS seq_of_match,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id
UNION ALL SELECT 'c/u' || (-1 - user_id) || '_aug2_scaled_aug2.mp4', NULL, NULL FROM (SELECT DISTINCT user_id FROM events)""")
def j9(spark, d):
    ev = t.load(spark, d, "events")
    rows = ev.select(F.concat(F.lit("f/U"), F.col("user_id").cast("string"), F.lit("_aug2.mp4")).alias("video_path"),
                     F.col("event_id").alias("seq"), F.col("event_id").alias("seq_of_match"), "value")
    users = ev.select("user_id").distinct()
    both = users.unionByName(users.select((-1 - F.col("user_id")).alias("user_id")))
    targets = both.select(F.concat(F.lit("c/u"), F.col("user_id").cast("string"), F.lit("_aug2_scaled_aug2.mp4")).alias("video_path"))
    return fe.match_exact(targets, rows, "seq").drop("matched_path")


_J10 = """targets AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 't/x' || lower(c_name) || 'y.mp4' WHEN o_custkey % 3 = 1
    THEN 't/0' || o_custkey || '.mp4' ELSE 't/none' || o_custkey || '.mp4' END AS video_path FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT video_path, substr(video_path, 3, length(video_path) - 6) AS tk FROM targets)"""


@query("j10_contained_keys", f"""WITH {_J10} SELECT video_path, 'c/' || arg_min(c_name, c_custkey) || '.mp4' AS matched_path
FROM k JOIN customer ON contains(lower(c_name), tk) OR contains(tk, lower(c_name)) GROUP BY video_path""")
def j10(spark, d):
    cust = t.load(spark, d, "customer")
    o = t.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(cust.hint("merge"), "c_custkey")
    i = F.col("c_custkey").cast("string")
    targets = o.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("t/x"), F.lower("c_name"), F.lit("y.mp4")))
                       .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("t/0"), i, F.lit(".mp4")))
                       .otherwise(F.concat(F.lit("t/none"), i, F.lit(".mp4"))).alias("video_path"))
    cands = cust.select(F.concat(F.lit("c/"), F.col("c_name"), F.lit(".mp4")).alias("video_path"), F.col("c_custkey").alias("seq"))
    return fe.match_contained(targets, cands)


_JOINED = f"""{TARGETS}, {STAGE2}, {STAGE4}, combined AS (
  SELECT o.video_path, o.id, o.label, a.quantity, a.price, a.discount, a.tax, a.lines, a.price_twice, a.constant, b.total, b.customer
  FROM targets o JOIN stage2 a ON a.seq = o.id JOIN stage4 b ON b.seq = o.id)"""


@query("j11_combined_features", f"""WITH {_JOINED} SELECT video_path, id, label, round(quantity, 8) AS stage2_quantity, round(price, 8) AS stage2_price,
  round(discount, 8) AS stage2_discount, round(tax, 8) AS stage2_tax, lines AS stage2_lines, round(price_twice, 8) AS stage2_price_twice,
  constant AS stage2_constant, total AS stage4_total, customer AS stage4_customer FROM combined""")
def j11(spark, d):
    out = fe.combine_stages(t.feature_targets(spark, d), t.stage2_features(spark, d), t.stage4_features(spark, d))
    places = {"stage2_quantity": 8, "stage2_price": 8, "stage2_discount": 8, "stage2_tax": 8, "stage2_price_twice": 8}
    return out.withColumns({c: F.round(c, p) for c, p in places.items()})


@query("j11_single_stage", f"WITH {TARGETS}, {STAGE4} SELECT o.video_path, id, label, total AS stage4_total, customer AS stage4_customer FROM targets o JOIN stage4 b ON b.seq = o.id")
def j11b(spark, d):
    return fe.combine_stages(t.feature_targets(spark, d), None, t.stage4_features(spark, d))


@query("p10_prefixed_features", f"WITH {STAGE4} SELECT video_path, total AS stage4_total, customer AS stage4_customer FROM stage4")
def p10(spark, d):
    return fe.prefixed(t.stage4_features(spark, d), "stage4_", ("video_path", "label", "feature_path", "seq"))


@query("f1_varying_features", f"""WITH {STAGE2} SELECT seq, round(quantity, 8) AS quantity, round(tax, 8) AS tax FROM stage2""")
def f1(spark, d):
    rows = t.stage2_features(spark, d)
    pruner = fe.FeaturePruner(method="none").fit(rows, ["quantity", "constant", "tax"])
    return pruner.transform(rows, ["seq"]).withColumns({c: F.round(c, p) for c, p in (("quantity", 8), ("tax", 8))})


@query("f2_pruned_features", f"""WITH {STAGE2} SELECT seq, round(quantity, 8) AS quantity, round(tax, 8) AS tax, round(price_twice, 8) AS price_twice FROM stage2""")
def f2(spark, d):
    rows = t.stage2_features(spark, d)
    pruner = fe.FeaturePruner().fit(rows, ["quantity", "price", "constant", "tax", "price_twice"])
    out = pruner.transform(rows, ["seq"])
    return out.withColumns({c: F.round(c, p) for c, p in (("quantity", 8), ("tax", 8), ("price_twice", 8)) if c in out.columns})


@query("f3_low_inflation_features", f"""WITH {STAGE2} SELECT seq, round(quantity, 8) AS quantity FROM stage2""")
def f3(spark, d):
    """price_twice is made of price and tax, so all three go."""
    rows = t.stage2_features(spark, d)
    pruner = fe.FeaturePruner(method="vif").fit(rows, ["quantity", "price", "tax", "price_twice"])
    return pruner.transform(rows, ["seq"]).withColumns({c: F.round(c, 8) for c in pruner.kept})


def gappy(spark, d):
    """Order values with gaps and NaN."""
    k = F.col("o_custkey")
    return t.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise((k % 97).cast("double")).alias("group"))


_GAPPY = """gappy AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 97 AS DOUBLE) END AS "group" FROM orders)"""


def _filled(price: str, group: str) -> str:
    return f"""WITH {_GAPPY} SELECT id, round(coalesce(price, (SELECT {price} FROM gappy)), 4) AS price,
  round(coalesce("group", (SELECT {group} FROM gappy)), 4) AS "group" FROM gappy"""


def _prepared(spark, d, **kw):
    rows = gappy(spark, d)
    return rounded(fe.FeaturePreprocessor(**kw).fit(rows, ["price", "group"]).transform(rows), 4)


@query("f4_mean_imputation", _filled("avg(price)", 'avg("group")'))
def f4a(spark, d):
    return _prepared(spark, d, imputation="mean", scaling=None, normalize=False)


@query("f4_median_imputation", _filled("quantile_cont(price, 0.5)", 'quantile_cont("group", 0.5)'))
def f4b(spark, d):
    return _prepared(spark, d, imputation="median", scaling=None, normalize=False)


_MODE = "(SELECT {0} FROM gappy WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


@query("f4_frequent_imputation", f"""WITH {_GAPPY} SELECT id, round(coalesce(price, {_MODE.format('price')}), 4) AS price,
  round(coalesce("group", {_MODE.format('"group"')}), 4) AS "group" FROM gappy""")
def f4c(spark, d):
    return _prepared(spark, d, imputation="most_frequent", scaling=None, normalize=False)


@query("f4_constant_imputation", f'WITH {_GAPPY} SELECT id, round(coalesce(price, -1.0::DOUBLE), 4) AS price, round(coalesce("group", -1.0::DOUBLE), 4) AS "group" FROM gappy')
def f4d(spark, d):
    return _prepared(spark, d, imputation="constant", constant=-1.0, scaling=None, normalize=False)


_FULL = f"""WITH {_GAPPY}, filled AS (SELECT id, coalesce(price, (SELECT avg(price) FROM gappy)) AS price,
  coalesce("group", (SELECT avg("group") FROM gappy)) AS grp FROM gappy)"""


@query("f5_standard_scaling", f"""{_FULL} SELECT id, round((price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled), 4) + 0.0::DOUBLE AS price,
  round((grp - (SELECT avg(grp) FROM filled)) / (SELECT stddev_pop(grp) FROM filled), 4) + 0.0::DOUBLE AS "group" FROM filled""")
def f5a(spark, d):
    return _prepared(spark, d, normalize=False)


@query("f5_robust_scaling", f"""{_FULL}, q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.5) AS p2, quantile_cont(price, 0.75) AS p3,
  quantile_cont(grp, 0.25) AS g1, quantile_cont(grp, 0.5) AS g2, quantile_cont(grp, 0.75) AS g3 FROM filled)
SELECT id, round((price - p2) / (p3 - p1), 4) + 0.0::DOUBLE AS price, round((grp - g2) / (g3 - g1), 4) + 0.0::DOUBLE AS "group" FROM filled, q""")
def f5b(spark, d):
    return _prepared(spark, d, scaling="robust", normalize=False)


@query("f6_unit_rows", """SELECT l_orderkey, l_partkey, l_quantity AS q, round(l_tax / n, 6) AS l_tax, round(l_discount / n, 6) AS l_discount FROM (
  SELECT *, CASE WHEN l_tax = 0 AND l_discount = 0 THEN 1 ELSE sqrt(l_tax * l_tax + l_discount * l_discount) END AS n FROM lineitem)""")
def f6(spark, d):
    rows = t.load(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("q"), "l_tax", "l_discount")
    out = fe.normalized_rows(rows, ["l_tax", "l_discount"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_tax", "l_discount")})


@query("f7_fitted_preprocessor", f"""WITH {_GAPPY}, filled AS (SELECT id, coalesce(price, -1.0::DOUBLE) AS price, coalesce("group", -1.0::DOUBLE) AS grp FROM gappy),
s AS (SELECT id, (price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled) AS p,
         (grp - (SELECT avg(grp) FROM filled)) / (SELECT stddev_pop(grp) FROM filled) AS g FROM filled)
SELECT id, round(p / sqrt(p * p + g * g), 4) + 0.0::DOUBLE AS price, round(g / sqrt(p * p + g * g), 4) + 0.0::DOUBLE AS "group" FROM s""")
def f7(spark, d):
    return _prepared(spark, d, imputation="constant", constant=-1.0)


@query("f8_training_features", f"""WITH {_JOINED} SELECT video_path, id, label, round(quantity, 8) AS stage2_quantity, round(discount, 8) AS stage2_discount,
  round(tax, 8) AS stage2_tax, lines AS stage2_lines, round(price_twice, 8) AS stage2_price_twice, total AS stage4_total,
  customer AS stage4_customer FROM combined""")
def f8(spark, d):
    targets = t.feature_targets(spark, d)
    split = sp.two_cut_split(targets, "id")
    out, _ = fe.load_features(split, t.stage2_features(spark, d), t.stage4_features(spark, d), fit_on=F.col("split") == "train")
    places = {"stage2_quantity": 8, "stage2_discount": 8, "stage2_tax": 8, "stage2_price_twice": 8}
    return out.drop("split").withColumns({c: F.round(c, p) for c, p in places.items()})
