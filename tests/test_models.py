import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import evaluate, models
from casebook.plans.exploration import Choices, explore, metric_table
from casebook.plans import results
from casebook.streaming import scoring
from tests.util import matrix


def auc(model, df):
    p = model.predict(df).select("label", "pred", F.lit("m").alias("m"), "case_id")
    return evaluate.auc_with_interval(evaluate.score_table(p, ["m"]), ["m"]).head().auc


@pytest.mark.parametrize("name", ["LR", "LRLasso", "LDA", "NB", "DT", "RF", "AB", "AE", "SVM"])
def test_separable_classes(spark, name):
    df, spec, pdf = matrix(spark, n=120, p=2)
    pdf["f0"] = pdf.f0.abs() * np.where(pdf.label == 1, 1, -1) + np.where(pdf.label == 1, 1, -1)
    df = spark.createDataFrame(pdf)
    fits = {"SVM": lambda d, s: models.linear_svm(d, s, max_iter=5), "AB": lambda d, s: models.ada_boost(d, s, rounds=3)}
    model = fits.get(name, models.CLASSIFIERS[name])(df, spec)
    assert auc(model, df) > 0.99


def test_logistic_gradient_is_zero(spark):
    df, spec, pdf = matrix(spark, n=200)
    m = models.logistic(df, spec, tol=1e-10)
    x = np.c_[np.ones(len(pdf)), pdf[list(spec.features)].to_numpy()]
    p = 1 / (1 + np.exp(-x @ np.r_[m.intercept, m.coef]))
    assert np.abs(x.T @ (pdf.label - p)).max() < 1e-2


def test_models_from_shared_moments(spark):
    df, spec, _ = matrix(spark, n=150, p=4)
    m = models.class_moments(df, spec)
    sub = spec.only(["f1", "f3"])
    a, b = models.discriminant_from(m.sub(sub.features)), models.discriminant(df, sub)
    assert (*a.coef, a.intercept) == pytest.approx((*b.coef, b.intercept), rel=1e-8)


def test_shrunk_discriminant_matches_numpy(spark):
    df, spec, pdf = matrix(spark, n=80, p=3)
    m = models.discriminant(df, spec, shrinkage="auto")
    cov, means, prior = np.zeros((3, 3)), [], []
    for k in (0, 1):
        x = pdf.loc[pdf.label == k, list(spec.features)].to_numpy()
        mu, sd = x.mean(axis=0), x.std(axis=0)
        z = (x - mu) / sd
        n, p = z.shape
        emp = z.T @ z / n
        mean_var = np.trace(emp) / p
        d2 = (emp**2).sum()
        beta = ((z**2).sum(axis=1) ** 2).sum() / n - d2
        beta, delta = beta / (p * n), (d2 - 2 * mean_var * np.trace(emp) + p * mean_var**2) / p
        sh = min(beta, delta) / delta
        cov += n / 80 * ((1 - sh) * emp + sh * mean_var * np.eye(p)) * np.outer(sd, sd)
        means.append(mu)
        prior.append(n / 80)
    assert m.coef == pytest.approx(np.linalg.solve(cov, means[1] - means[0]), rel=1e-6)


def test_contributions_add_up(spark):
    df, spec, _ = matrix(spark, n=50)
    m = models.discriminant(df, spec)
    phi = models.linear_shap(df, spec, m).toPandas().set_index("case_id").sum(axis=1)
    margin = df.select("case_id", m.margin().alias("z")).toPandas().set_index("case_id").z
    assert np.allclose((margin - margin.mean()).loc[phi.index], phi)


def test_out_of_fold_scores_cover_every_case(spark):
    df, spec, _ = matrix(spark, n=61)
    cv = models.cross_predict(df, spec, models.discriminant, folds=4).toPandas()
    assert cv.case_id.is_unique and len(cv) == 61


def test_grid_points_are_unions_of_products():
    pts = models.grid_points([{"a": [1, 2], "b": [3, 4]}, {"a": [9], "c": "None"}])
    assert len(pts) == 5 and {"a": 9} in pts and models.grid_points([{}]) == [{}]


def test_exploration_scoring_and_stream(spark, tmp_path):
    df, spec, pdf = matrix(spark, n=160, p=5, signal=2.0)
    train, test = df.filter("case_id < 'c00120'"), df.filter("case_id >= 'c00120'")
    c = Choices(normalizers=("Zscore", "MinMax"), selectors=("ANOVA", "KW"), numbers=(1, 3), classifiers=("LDA", "NB"), folds=3)
    out = explore(train, spec, c, test=test)
    m = out.metrics.toPandas()
    assert len(m) == 2 * 2 * 2 * 2 * 4
    sizes = m.groupby("split").number.unique().map(list).to_dict()
    assert sizes["test"] == [40] and sizes["train"] == [120] and sizes["cv_val"] == [120]
    # F and rank scores are scale free, so both normalisers chose the same features
    chosen = {k: v["features"] for k, v in out.prepared.items()}
    for k, v in chosen.items():
        assert v == chosen[("Zscore", *k[1:])]
    train_cut = metric_table(out.predictions, train_cutoff=True).toPandas()
    assert (train_cut.groupby(["normalizer", "selector", "n_features", "classifier"]).cutoff.nunique() == 1).all()

    key = ("Zscore", "PCC", "ANOVA", 3, "LDA")
    prepared = out.prepared[key]
    batch = scoring.score(test, spec, prepared).toPandas().set_index("case_id").pred
    stored = out.predictions.filter(
        "split = 'test' and normalizer = 'Zscore' and selector = 'ANOVA' and n_features = 3 and classifier = 'LDA'"
    ).toPandas().set_index("case_id").pred
    assert np.allclose(batch, stored.loc[batch.index])

    scoring.save_prepared(spark, prepared, str(tmp_path / "model"))
    loaded = scoring.load_prepared(spark, str(tmp_path / "model"))
    assert loaded["model"] == prepared["model"]
    test.write.parquet(str(tmp_path / "in"))
    stream = scoring.apply_cutoff(scoring.score_stream(spark, str(tmp_path / "in"), test.schema, spec, loaded), 0.5)
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ckpt")
    ).start()
    q.awaitTermination(120)
    live = spark.table("scored").toPandas().set_index("case_id")
    assert np.allclose(live.pred.loc[batch.index], batch) and set(live.called) <= {0, 1}

    best = results.one_standard_error(
        out.metrics.filter("split = 'cv_val'"), ["normalizer", "reducer", "selector", "classifier"]
    )
    assert best.count() == 8


def test_saved_transformer_model(spark, tmp_path):
    df, spec, _ = matrix(spark, n=80)
    m = models.decision_tree(df, spec, max_depth=3)
    prepared = {
        "raw_features": list(spec.features),
        "normalizer": [{"feature": f, "slope": 1.0, "intercept": 0.0} for f in spec.features],
        "reducer": None,
        "features": list(spec.features),
        "model": m,
    }
    scoring.save_prepared(spark, prepared, str(tmp_path / "tree"))
    loaded = scoring.load_prepared(spark, str(tmp_path / "tree"))
    a = scoring.score(df, spec, prepared).toPandas()
    b = scoring.score(df, spec, loaded).toPandas()
    assert a.equals(b)


def test_leak_free_exploration(spark):
    df, spec, _ = matrix(spark, n=90, p=4)
    c = Choices(balance="None", normalizers=("Zscore",), reducers=("PCA",), selectors=("ANOVA",), numbers=(2,), classifiers=("LDA",), folds=2, leak_free=True)
    out = explore(df, spec, c)
    assert set(out.metrics.toPandas().split) == {"balance_train", "train", "cv_val"}
