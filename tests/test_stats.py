import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.functions import tails
from casebook.operators import firstorder, gram, normalize, reduce, select, stats
from casebook.spec import MatrixSpec
from tests.util import matrix


def test_known_tail_values():
    assert tails.normal_upper(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.f_upper(4.9646027437307145, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.log10_normal_upper(40) == pytest.approx(-349.4370, abs=1e-3)
    assert tails.chi2_upper(5.0, 1) == pytest.approx(math.erfc(math.sqrt(2.5)), abs=1e-12)


def test_f_is_t_squared_and_scale_free(spark):
    df, spec, _ = matrix(spark)
    f = {r.feature: r.f for r in stats.anova_f(df, spec).collect()}
    t = {r.feature: r.t for r in stats.t_test(df, spec, F.col("label") == 1).collect()}
    for k in f:
        assert f[k] == pytest.approx(t[k] ** 2, rel=1e-9)
    scaled = normalize.apply_normalizer(df, spec, normalize.fit_normalizer(df, spec, "MinMax"))
    for r in stats.anova_f(scaled, spec).collect():
        assert r.f == pytest.approx(f[r.feature], rel=1e-8)


def test_kruskal_is_squared_rank_z(spark):
    df, spec, _ = matrix(spark)
    sums = stats.rank_sums(stats.two_side_counts(df, spec, F.col("label") == 1))
    for r in stats.kruskal_wallis(stats.mann_whitney(sums)).collect():
        n = r.m1 + r.m0
        sd = math.sqrt(r.m1 * r.m0 / 12 * ((n + 1) - r.ties / (n * (n - 1))))
        assert r.h == pytest.approx(((r.u - r.m1 * r.m0 / 2) / sd) ** 2, rel=1e-9)


@pytest.mark.parametrize("p", [5, 300])
def test_every_caller_works_at_any_width(spark, p):
    from casebook.operators import models, normalize

    df, spec, pdf = matrix(spark, n=60, p=p)
    feats = list(spec.features)
    mean = stats.per_feature(df, spec, {"m": F.avg}).toPandas().set_index("feature").m
    assert np.allclose(mean[feats], pdf[feats].mean())
    by = stats.per_feature(df, spec, {"m": F.avg}, by=["label"]).toPandas().set_index(["label", "feature"]).m
    assert np.allclose(by[1][feats], pdf[pdf.label == 1][feats].mean())
    r = stats.label_correlation(df, spec).toPandas().set_index("feature").r
    assert np.allclose(r[feats], pdf[feats].corrwith(pdf.label).abs())
    a, b = (pdf[pdf.label == y][feats] for y in (1, 0))
    t = stats.t_test(df, spec, F.col("label") == 1).toPandas().set_index("feature").t
    pooled = ((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(pdf) - 2)
    want = (a.mean() - b.mean()) / np.sqrt(pooled * (1 / len(a) + 1 / len(b)))
    assert np.allclose(t[feats], want)
    f = stats.anova_f(df, spec).toPandas().set_index("feature").f
    assert np.allclose(f[feats], want**2)
    assert stats.distribution_type(df, spec).count() == p
    assert normalize.fit_normalizer(df, spec, "Zscore")
    assert models.class_moments(df, spec).mean.shape == (2, p)


def test_missing_cells_and_sides_are_not_ranked(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 60).astype(float)
    side = np.arange(60) % 3
    rows = [(f"c{i}", None if side[i] == 2 else bool(side[i]), None if i % 5 == 0 else float(x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "case_id string, label boolean, f0 double")
    got = stats.rank_sums(stats.two_side_counts(df, MatrixSpec(("f0",)), F.col("label"))).head()
    seen = pd.DataFrame([(s, v) for _, s, v in rows if s is not None and v is not None], columns=["s", "v"])
    ranks = seen.v.rank()
    assert (got.m1, got.m0) == ((seen.s).sum(), (~seen.s.astype(bool)).sum())
    assert got.rank_sum == ranks[seen.s.astype(bool)].sum() and got.n_values == seen.v.nunique()


def test_few_valued_is_exact(spark):
    pdf = pd.DataFrame({"case_id": range(500), "label": 0, "a": np.arange(500) % 9, "b": np.arange(500) % 10, "c": np.arange(500)})
    df = spark.createDataFrame(pdf)
    assert stats.few_valued(df, MatrixSpec(("a", "b", "c"))) == ["a"]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"case_id": ["a"] * 90 + ["b"] * 7, "series": "s", "value": rng.normal(size=97).round(1)})
    got = firstorder.group_quantiles(spark.createDataFrame(pdf), ["case_id", "series"], "value", {"q": 0.3}).collect()
    for r in got:
        assert r.q == pytest.approx(np.quantile(pdf.value[pdf.case_id == r.case_id], 0.3))


def test_icc_of_identical_raters_and_constants(spark):
    df, spec, pdf = matrix(spark, n=30)
    for r in stats.icc(df, df, spec).collect():
        assert (r.icc1, r.icc2, r.icc3) == pytest.approx((1, 1, 1))
    same = spark.createDataFrame(pdf.assign(f0=1.0))
    row = {r.feature: r for r in stats.icc(same, same, spec).collect()}["f0"]
    assert (row.icc1, row.icc2, row.icc3) == (1.0, 1.0, 1.0)


def test_inflation_matches_regression_and_flags_dependence(spark):
    df, spec, pdf = matrix(spark, n=120, p=4)
    pdf["f3"] = pdf.f0 * 2 + pdf.f1 + np.random.default_rng(1).normal(size=len(pdf)) * 0.5
    x = pdf[list(spec.features)].to_numpy()
    got = {r["feature"]: r["vif"] for r in reduce.inflation_table(spark.createDataFrame(pdf), spec)}
    for j, f in enumerate(spec.features):
        a = np.c_[np.ones(len(x)), np.delete(x, j, 1)]
        res = x[:, j] - a @ np.linalg.lstsq(a, x[:, j], rcond=None)[0]
        assert got[f] == pytest.approx(1 / (res.var() / x[:, j].var()), rel=1e-6)
    pdf["f3"] = pdf.f0 + pdf.f1
    dep = {r["feature"]: r["vif"] for r in reduce.inflation_table(spark.createDataFrame(pdf), spec)}
    assert math.isinf(dep["f0"]) and dep["f2"] < 2


def test_pearson_filter_keeps_the_better_copy(spark):
    df, spec, pdf = matrix(spark, n=300, p=3)
    pdf["a"] = pdf.f0 + np.random.default_rng(0).normal(size=len(pdf)) * 0.01  # noisy copy, first in name order
    spec = MatrixSpec(("a", "f0", "f1", "f2"))
    g = gram.feature_gram(spark.createDataFrame(pdf), spec, with_label=True)
    r = np.abs(np.corrcoef(pdf[["a", "f0", "label"]].to_numpy().T))
    keep = gram.uncorrelated(g, "label")
    assert ("a" in keep) == (r[0, 2] >= r[1, 2]) and len(keep) == 3


def test_feature_clusters_group_copies(spark):
    df, spec, pdf = matrix(spark, n=80, p=2)
    for i in range(3):
        pdf[f"g{i}"] = pdf.f0 + 0.001 * i
        pdf[f"h{i}"] = pdf.f1 * (1 + 0.001 * i)
    spec = MatrixSpec(tuple(sorted(c for c in pdf if c not in ("case_id", "label"))))
    g = gram.feature_gram(spark.createDataFrame(pdf), spec, scaling="minmax")
    lab = dict(zip(g.names, gram.cluster_features(g, 2)))
    assert len({lab[c] for c in ("f0", "g0", "g1", "g2")}) == 1
    assert len({lab[c] for c in ("f1", "h0", "h1", "h2")}) == 1 and lab["f0"] != lab["f1"]


def test_pca_components_are_uncorrelated(spark):
    df, spec, _ = matrix(spark, n=100, p=3)
    state = reduce.fit_pca(df, spec)
    out, pspec = reduce.apply_pca(df, spec, state)
    x = out.toPandas()[list(pspec.features)].to_numpy()
    c = np.cov(x.T)
    assert np.abs(c - np.diag(np.diag(c))).max() < 1e-9
    assert np.allclose(np.diag(c) / np.trace(c), state["variance"])


def test_constant_feature_maps_to_zero(spark):
    df, spec, pdf = matrix(spark)
    df = spark.createDataFrame(pdf.assign(f1=4.0))
    for m in ("Zscore", "MinMax", "Mean"):
        out = normalize.apply_normalizer(df, spec, normalize.fit_normalizer(df, spec, m)).toPandas()
        assert (out.f1 == 0).all()


def test_relief_matches_brute_force(spark):
    df, spec, pdf = matrix(spark, n=60)
    x = pdf[list(spec.features)].to_numpy()
    x = x / np.linalg.norm(x, axis=0)
    y = pdf.label.to_numpy()
    w = np.zeros(3)
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit = min((j for j in range(len(x)) if y[j] == y[i]), key=lambda j: (d[j], j))
        miss = min((j for j in range(len(x)) if y[j] != y[i]), key=lambda j: (d[j], j))
        w += (x[i] - x[miss]) ** 2 - (x[i] - x[hit]) ** 2
    got = {r.feature: r.weight for r in select.relief_weights(df, spec).collect()}
    assert [got[f] for f in spec.features] == pytest.approx(w.tolist(), rel=1e-9)


def test_elimination_keeps_the_signal(spark):
    df, spec, _ = matrix(spark, n=200, p=4, signal=5.0)
    ranks = {r["feature"]: r["rank"] for r in select.rfe_ranks(df, spec, 1)}
    assert ranks["f0"] == 1 and sorted(ranks.values()) == [1, 2, 3, 4]


def test_total_of_many_large_values_keeps_its_decimals(spark):
    df = spark.range(0, 400_000, 1, 1).select(F.col("id").alias("case_id"), F.lit(0).alias("label"), (4e8 + F.col("id") % 100 / 100).alias("x"))
    total = stats.describe(df, MatrixSpec(("x",))).head().total
    assert total == 400_000 * 4e8 + 4_000 * 49.5
    odd = spark.createDataFrame([(1, 0, float("inf"), None), (2, 0, 1.5, None)], "case_id long, label int, x double, y double")
    found = {r.feature: r.total for r in stats.describe(odd, MatrixSpec(("x", "y"))).collect()}
    assert found["x"] == float("inf") and found.get("y") is None
