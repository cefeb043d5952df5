"""Classifiers, contributions, the exploration loop and scoring."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import evaluate, models, normalize
from casebook.operators.stats import per_feature
from casebook.plans import exploration
from casebook.queries import query
from casebook.queries.sql import DM, OM, r
from casebook.session import kept
from casebook.sources import kept_tables as t
from casebook.streaming import scoring


def _standardised(spark, sf, features=None):
    """Standardised orders matrix, with all features if none are named."""
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(features) if features else spec
    return normalize.apply_normalizer(spec.project(df), spec, normalize.fit_normalizer(df, spec, "Zscore")), spec


def _quality(model, df):
    """One row: how well the fitted model separates the cases it was fitted on."""
    # the metrics pass over the scores several times, and a forest is read anew whenever it scores
    preds = kept(model.predict(df).select("case_id", "label", "pred", F.lit(model.name).alias("model")))
    return evaluate.metric_rows(preds, ["model"]).select("model", "number", "auc", "std", "auc_pr", "acc")


def _fit_query(name):
    def run(spark, sf):
        df, spec = _standardised(spark, sf)
        return _quality(models.CLASSIFIERS[name](df, spec), df)

    return run


for _name, _key in (
    ("LR", "logistic_regression"),
    ("LRLasso", "lasso_logistic_regression"),
    ("DT", "decision_tree"),
    ("RF", "random_forest"),
):
    query(_key)(_fit_query(_name))


_COVARIATES = ["disc_avg", "lines", "qty_avg", "tax_avg", "total"]


@query(
    "stationary_coefficients",
    "SELECT model, feature, true AS stationary FROM (SELECT unnest(['LR', 'LRLasso']) AS model), "
    f"(SELECT unnest({_COVARIATES}) AS feature)",
)
def stationary_coefficients(spark, sf):
    """At a solver's end the mean loss has no slope left; under an absolute penalty no more than the penalty,
    and all of it against the sign of a coefficient that is not zero."""
    df, spec = _standardised(spark, sf, _COVARIATES)
    n, rows = df.count(), []
    for model, weight in ((models.logistic(df, spec, tol=1e-8), 0.0), (models.lasso_logistic(df, spec, tol=1e-9, max_iter=1000), 1.0 / n)):
        error = F.col("pred") - F.col("label")
        slopes = model.predict(df).agg(*[F.avg(error * F.col(f)).alias(f) for f in spec.features]).head()
        for f, b in zip(spec.features, model.coef):
            pull, slack = (0.0, weight) if b == 0 else (math.copysign(weight, b), 0.0)
            rows.append({"model": model.name, "feature": f, "stationary": abs(slopes[f] + pull) <= slack + 1e-4})
    return normalize.state_table(spark, rows)


@query("linear_svm")
def linear_svm(spark, sf):
    df, spec = _standardised(spark, sf)
    return _quality(models.linear_svm(df, spec), df)


@query("ada_boost")
def ada_boost(spark, sf):
    df, spec = _standardised(spark, sf)
    return _quality(models.ada_boost(df, spec), df)


@query("perceptron")
def perceptron(spark, sf):
    df, spec = _standardised(spark, sf)
    return _quality(models.perceptron(df, spec), df)


_LDA = f"""{OM},
c AS (SELECT label, count(*)::DOUBLE AS n, avg(lines) AS a, avg(qty_avg) AS b, var_pop(lines) AS aa, var_pop(qty_avg) AS bb,
 covar_pop(lines, qty_avg) AS ab FROM om GROUP BY 1),
g AS (SELECT x.n AS n0, y.n AS n1, x.a AS a0, y.a AS a1, x.b AS b0, y.b AS b1, (x.n * x.aa + y.n * y.aa) / (x.n + y.n - 2) AS aa,
 (x.n * x.bb + y.n * y.bb) / (x.n + y.n - 2) AS bb, (x.n * x.ab + y.n * y.ab) / (x.n + y.n - 2) AS ab
 FROM c x, c y WHERE x.label = 0 AND y.label = 1),
w AS (SELECT *, (bb * (a1 - a0) - ab * (b1 - b0)) / (aa * bb - ab * ab) AS wa, (aa * (b1 - b0) - ab * (a1 - a0)) / (aa * bb - ab * ab) AS wb FROM g),
lda AS (SELECT wa, wb, -0.5 * ((a0 + a1) * wa + (b0 + b1) * wb) + ln(n1 / n0) AS w0, (n0 * a0 + n1 * a1) / (n0 + n1) AS ma,
 (n0 * b0 + n1 * b1) / (n0 + n1) AS mb FROM w)"""


@query(
    "discriminant_scores",
    f"WITH {_LDA} SELECT case_id, label, {r('1 / (1 + exp(-(w0 + wa * lines + wb * qty_avg)))', 7)} AS pred FROM om, lda",
)
def discriminant_scores(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_avg"])
    model = models.discriminant(df, spec)
    return model.predict(spec.project(df)).select("case_id", "label", rounded("pred", 7).alias("pred"))


@query(
    "model_coefficients",
    f"WITH {_LDA} SELECT 'lines' AS feature, {r('wa', 7)} AS coef FROM lda UNION ALL "
    f"SELECT 'qty_avg', {r('wb', 7)} FROM lda UNION ALL SELECT 'intercept', {r('w0', 7)} FROM lda",
)
def model_coefficients(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    model = models.discriminant(df, spec.only(["lines", "qty_avg"]))
    return model.coefficients(spark).select("feature", rounded("coef", 7).alias("coef"))


@query("discriminant_shrunk")
def discriminant_shrunk(spark, sf):
    df, spec = _standardised(spark, sf)
    return _quality(models.discriminant(df, spec, shrinkage="auto"), df)


_NB_F = ("lines", "qty_avg", "tax_avg")
_NB = (
    f"{OM}, g AS (SELECT label, count(*)::DOUBLE AS n, "
    + ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in _NB_F)
    + " FROM om GROUP BY 1), e AS (SELECT 1e-9::DOUBLE * greatest("
    + ", ".join(f"var_pop({f})" for f in _NB_F)
    + ") AS eps FROM om), l AS (SELECT om.case_id, om.label AS truth, g.label, ln(n) + "
    + " + ".join(f"(-0.5 * ln(v_{f} + eps) - (om.{f} - m_{f}) ** 2 / (2 * (v_{f} + eps)))" for f in _NB_F)
    + " AS ll FROM om, g, e), p AS (SELECT case_id, truth, max(ll) FILTER (WHERE label = 1) AS l1, max(ll) FILTER (WHERE label = 0) AS l0 FROM l GROUP BY 1, 2)"
)


@query(
    "naive_bayes_scores",
    f"WITH {_NB} SELECT case_id, truth AS label, {r('1 / (1 + exp(l0 - l1))', 7)} AS pred FROM p",
)
def naive_bayes_scores(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(_NB_F)
    return models.gaussian_bayes(df, spec).predict(spec.project(df)).select(
        "case_id", "label", rounded("pred", 7).alias("pred")
    )


_COEF = {"lines": 0.4, "qty_avg": -0.02, "total": 0.000001}


@query(
    "linear_model_scores",
    f"WITH {OM} SELECT case_id, label, {r('1 / (1 + exp(-(0.3::DOUBLE + ' + ' + '.join(f'{w}::DOUBLE * {f}' for f, w in _COEF.items()) + ')))')} AS pred FROM om",
)
def linear_model_scores(spark, sf):
    df, _ = t.orders_matrix(spark, sf)
    m = models.LinearScore("given", tuple(_COEF), tuple(_COEF.values()), 0.3)
    return m.predict(df).select("case_id", "label", rounded("pred").alias("pred"))


@query(
    "linear_contributions",
    f"WITH {_LDA} SELECT case_id, {r('wa * (lines - ma)', 7)} AS lines, {r('wb * (qty_avg - mb)', 7)} AS qty_avg FROM om, lda",
)
def linear_contributions(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_avg"])
    phi = models.linear_shap(df, spec, models.discriminant(df, spec))
    return phi.select("case_id", rounded("lines", 7).alias("lines"), rounded("qty_avg", 7).alias("qty_avg"))


@query("cross_validated_scores")
def cross_validated_scores(spark, sf):
    df, spec = _standardised(spark, sf)
    return models.cross_predict(df, spec, models.discriminant, folds=5)


@query("grid_search")
def grid_search(spark, sf):
    df, spec = _standardised(spark, sf)
    _, rows = models.grid_search(df, spec, "LDA")
    return normalize.state_table(spark, rows)


@query("network_grid_search")
def network_grid_search(spark, sf):
    """All options of the network by fold accuracy on the labelled documents, fitted together."""
    df, spec = t.docs_matrix(spark, sf)
    scaled = normalize.apply_normalizer(spec.project(df), spec, normalize.fit_normalizer(df, spec, "Zscore"))
    _, rows = models.grid_search(scaled, spec, "AE")
    return normalize.state_table(spark, rows)


# A given network: two features, three rectified units, one score. Rows of _NET: weights of both features, offset, output weight.
_NET = ((0.25, 0.5, -1.0, 0.75), (-0.5, 0.125, 2.0, -0.5), (1.0, -0.25, 0.5, 0.25))
_NET_OUT = " + ".join(f"{o}::DOUBLE * greatest({a}::DOUBLE * lines + {b}::DOUBLE * qty_avg + {c}::DOUBLE, 0)" for a, b, c, o in _NET)


@query("network_scores", f"WITH {OM} SELECT case_id, label, {r(f'1 / (1 + exp(-(0.125::DOUBLE + {_NET_OUT})))', 7)} AS pred FROM om")
def network_scores(spark, sf):
    """Scores of a network with given weights."""
    df, _ = t.orders_matrix(spark, sf)
    first, second, offset, out = zip(*_NET)
    m = models.NetworkScore("given", ("lines", "qty_avg"), (*first, *second, *offset, *out, 0.125), (2, 3, 1))
    return m.predict(df).select("case_id", "label", rounded("pred", 7).alias("pred"))


@query("grid_search_spark_estimator")
def grid_search_spark_estimator(spark, sf):
    from pyspark.ml.classification import LogisticRegression

    df, spec = _standardised(spark, sf)
    est = LogisticRegression(featuresCol="_v", labelCol="y", maxIter=20)
    cv = models.spark_grid_search(df, spec, est, [{"regParam": [0.0, 0.1]}])
    return normalize.state_table(spark, [{"option": i, "accuracy": float(a)} for i, a in enumerate(cv.avgMetrics)])


def explored(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    ids = F.pmod(F.xxhash64("case_id"), F.lit(10))
    df = spec.project(df)
    return exploration.explore(df.filter(ids >= 3), spec, exploration.Choices(), test=df.filter(ids < 3))


@query("exploration_metrics")
def exploration_metrics(spark, sf):
    """Every combination of preparation and classifier on a train and test table, as metric rows."""
    return explored(spark, sf).metrics


@query(
    "saved_model_scores",
    f"""WITH {OM}, s AS (SELECT avg(lines) AS ml, stddev_pop(lines) AS sl, avg(qty_avg) AS mq, stddev_pop(qty_avg) AS sq FROM om)
SELECT case_id, label, {r('1 / (1 + exp(-(0.1::DOUBLE + 0.5::DOUBLE * (lines - ml) / sl - 0.25::DOUBLE * (qty_avg - mq) / sq)))')} AS pred FROM om, s""",
)
def saved_model_scores(spark, sf):
    """Scoring path with fitted scaling and given coefficients."""
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_avg"])
    prepared = {
        "raw_features": list(spec.features),
        "normalizer": normalize.fit_normalizer(df, spec, "Zscore"),
        "reducer": None,
        "features": ["lines", "qty_avg"],
        "model": models.LinearScore("given", ("lines", "qty_avg"), (0.5, -0.25), 0.1),
    }
    return scoring.score(df, spec, prepared).select("case_id", "label", rounded("pred").alias("pred"))
