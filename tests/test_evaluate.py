import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.operators import evaluate as e


def preds(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    s = np.clip((0.3 * y + rng.random(n)).round(2), 0, 1.3)
    pdf = pd.DataFrame({"m": "x", "case_id": [str(i) for i in range(n)], "pred": s, "label": y})
    return spark.createDataFrame(pdf), pdf


def auc_of(spark, pdf):
    df = spark.createDataFrame(pdf)
    return e.auc_with_interval(e.score_table(df, ["m"]), ["m"]).head()


def test_auc_by_pairs_and_symmetry(spark):
    df, pdf = preds(spark)
    r = auc_of(spark, pdf)
    a, b = pdf.pred[pdf.label == 1].to_numpy(), pdf.pred[pdf.label == 0].to_numpy()
    wins = (a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()
    assert r.auc == pytest.approx(wins, abs=1e-12)
    place_a = (a[:, None] > b).mean(axis=1) + 0.5 * (a[:, None] == b).mean(axis=1)
    place_b = (a[:, None] > b).mean(axis=0) + 0.5 * (a[:, None] == b).mean(axis=0)
    std = np.sqrt(place_a.var(ddof=1) / len(a) + place_b.var(ddof=1) / len(b))
    assert r.std == pytest.approx(std, abs=1e-12)
    flipped = auc_of(spark, pdf.assign(pred=-pdf.pred))
    assert r.auc + flipped.auc == pytest.approx(1, abs=1e-12)
    grown = auc_of(spark, pdf.assign(pred=np.exp(pdf.pred)))
    assert grown.auc == pytest.approx(r.auc, abs=1e-12)


def test_perfect_and_all_tied(spark):
    _, pdf = preds(spark)
    r = auc_of(spark, pdf.assign(pred=pdf.label.astype(float)))
    assert (r.auc, r.std, r.ci_low, r.ci_high, r.auc_pr) == (1.0, 0.0, 1.0, 1.0, 1.0)
    t = auc_of(spark, pdf.assign(pred=0.5))
    assert t.auc == 0.5
    cut = e.youden_cutoff(e.score_table(spark.createDataFrame(pdf.assign(pred=0.5)), ["m"]), ["m"]).head()
    assert cut.cutoff == float("inf")


def test_one_class_only_gives_a_row(spark):
    _, pdf = preds(spark)
    r = e.metric_rows(spark.createDataFrame(pdf[pdf.label == 1]), ["m"]).head()
    assert r.neg == 0 and r.spe == 0.0


def test_metrics_do_not_depend_on_partitioning(spark):
    df, _ = preds(spark)
    one = e.metric_rows(df.repartition(1), ["m"]).head()
    many = e.metric_rows(df.repartition(16), ["m"]).head()
    assert one.asDict() == pytest.approx(many.asDict())


def test_delong_comparison_matches_placements(spark):
    df, pdf = preds(spark)
    rng = np.random.default_rng(9)
    pdf["other"] = (pdf.pred * 0.5 + rng.random(len(pdf))).round(2)
    got = e.compare_models(spark.createDataFrame(pdf), a="pred", b="other").head()

    def place(col):
        a, b = pdf[col][pdf.label == 1].to_numpy(), pdf[col][pdf.label == 0].to_numpy()
        m = (a[:, None] > b) + 0.5 * (a[:, None] == b)
        return m.mean(axis=1), m.mean(axis=0), m.mean()

    (a1, b1, u1), (a2, b2, u2) = place("pred"), place("other")
    cov = np.cov(a1, a2) / len(a1) + np.cov(b1, b2) / len(b1)
    z = abs(u1 - u2) / np.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert got.z == pytest.approx(z, rel=1e-9)


def test_given_cutoff_is_used(spark):
    df, pdf = preds(spark)
    cut = spark.createDataFrame([("x", 0.7)], "m string, cutoff double")
    r = e.metric_rows(df, ["m"], cut).head()
    assert r.acc == pytest.approx(((pdf.pred >= 0.7).astype(int) == pdf.label).mean())
    c = e.confusion_metrics(df, ["m"], 0.7).head()
    assert (c.acc, c.mcc, c.npv) == pytest.approx((r.acc, r.mcc, r.npv))


def test_trapezoid_of_roc_points(spark):
    df, _ = preds(spark)
    scores = e.score_table(df, ["m"])
    pts = e.roc_points(scores, ["m"]).toPandas().sort_values(["fpr", "tpr"])
    area = np.trapezoid(pts.tpr, pts.fpr)
    assert area == pytest.approx(e.auc_with_interval(scores, ["m"]).head().auc, abs=1e-12)
    assert e.outlier_rows(df, ["m"]).count() == e.box_plot_rows(df, ["m"]).agg(F.sum("outliers")).head()[0]
