import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vidspark.operators import metrics as m
from vidspark.operators import ranking as rk
from vidspark.operators import results as r


def preds(spark, rows):
    return spark.createDataFrame([(int(y), int(p), float(s)) for y, p, s in rows], "y_true int, y_pred int, p1 double")


@pytest.mark.parametrize("rows,acc,f1", [
    ([(1, 1, 1), (0, 0, 0)], 1.0, 1.0), ([(1, 0, 0), (0, 1, 1)], 0.0, 0.0), ([(1, 1, 1), (0, 1, 1)], 0.5, 2 / 3),
    ([(1, 0, 0), (0, 0, 0)], 0.5, 0.0), ([(1, 1, 1), (1, 1, 1)], 1.0, 1.0)])
def test_edge_predictions(spark, rows, acc, f1):
    out = m.basic_metrics(preds(spark, rows)).head()
    assert out["accuracy"] == acc and out["f1"] == pytest.approx(f1)


def test_no_rows(spark):
    out = m.basic_metrics(preds(spark, [(1, 1, 1)]).where("y_true = 5")).head()
    assert out["accuracy"] == 0 and out["f1"] == 0


def test_loss_needs_probabilities(spark):
    rows = preds(spark, [(1, 1, 0.8), (0, 0, 0.3)])
    assert math.isnan(m.full_metrics(rows, prob=None).head()["val_loss"])
    assert m.full_metrics(rows).head()["val_loss"] == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2, abs=1e-6)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0])), min_size=2, max_size=60))
def test_auc_and_precision_by_pairs(spark, rows):
    steps = m.score_steps(preds(spark, [(y, 0, s) for y, s in rows]))
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    auc = m.roc_auc(steps).head()["roc_auc"]
    if pos and neg:
        assert auc == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    else:
        assert auc is None
    if pos:
        ap, last = 0.0, 0.0
        for t in sorted({s for _, s in rows}, reverse=True):
            recall = sum(p >= t for p in pos) / len(pos)
            ap += (recall - last) * sum(p >= t for p in pos) / sum(s >= t for _, s in rows)
            last = recall
        assert m.average_precision(steps).head()["average_precision"] == pytest.approx(ap)


def test_class_weights(spark):
    def weights(counts):
        df = spark.createDataFrame([(c,) for c, n in enumerate(counts) for _ in range(n)], "label int")
        return [x["weight"] for x in m.class_weights(df).orderBy("label").collect()]
    assert weights([5, 5]) == pytest.approx([1.0, 1.0])
    assert weights([10, 2]) == pytest.approx([1 / 3, 5 / 3], rel=1e-5)
    assert weights([10, 0]) == pytest.approx([1.0])


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(4000, 7.25), rng.normal(0, 50, 6000)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)] + [(0, None), (1, float("nan"))], "g int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    for row in rk.exact_quantiles(df, ["g"], "v", probs).collect():
        want = np.quantile(values[row["g"]::2], list(probs.values()))
        np.testing.assert_allclose([row[n] for n in probs], want, rtol=1e-12)
    whole = rk.exact_quantiles(df, [], "v", probs).head()
    np.testing.assert_allclose([whole[n] for n in probs], np.quantile(values, list(probs.values())), rtol=1e-12)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(6)
    s = rng.random(3000)
    out = m.score_histogram(preds(spark, [(i % 2, 0, v) for i, v in enumerate(s)])).collect()
    for y in (0, 1):
        want, _ = np.histogram(s[y::2], bins=50)
        got = np.zeros(50, int)
        for row in out:
            if row["y_true"] == y:
                got[row["bin"]] = row["n"]
        assert np.abs(got - want).sum() <= 2  # values on an edge may round either way
    one = m.score_histogram(preds(spark, [(1, 1, 0.5)] * 3)).collect()
    assert [(x["bin"], x["n"]) for x in one] == [(25, 3)]


@pytest.mark.parametrize("df,want", [(1, 12.7062), (4, 2.7764), (10, 2.2281), (30, 2.0423), (120, 1.9799)])
def test_t_quantiles(df, want):
    assert r.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)
    assert r.t_two_sided(want, df) == pytest.approx(0.05, abs=1e-4)


def test_pairwise_t(spark):
    rows = [("a", v) for v in (0.9, 0.91, 0.92)] + [("b", v) for v in (0.5, 0.51, 0.52)] + [("c", v) for v in (0.9, 0.91, 0.92)]
    out = {(x["model_1"], x["model_2"]): x for x in r.pairwise_t_tests(spark.createDataFrame(rows, "model string, val_acc double")).collect()}
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert out["a", "b"]["t_statistic"] == pytest.approx(0.4 / (0.01 * math.sqrt(2 / 3))) and out["a", "b"]["significant"] == "Yes"
    assert out["a", "c"]["p_value"] == pytest.approx(1.0) and out["a", "c"]["significant"] == "No"


def test_identifiers():
    assert r.check_identifier("stage_1") == "stage_1"
    for bad in ("a b", "x;drop", "", "a.b", "__"):
        with pytest.raises(ValueError):
            r.check_identifier(bad)
