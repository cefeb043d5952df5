"""Normalisation, dimension reduction and feature clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import gram, normalize, reduce
from casebook.queries import query
from casebook.queries.sql import DM, EM, OM, OS, r
from casebook.sources import kept_tables as t
from casebook.sources.tables import ORDER_FEATURES


def _scaled_sql(intercept, spread):
    cells = ", ".join(
        f"{r(f'coalesce((om.{f} - s.i_{f}) / nullif(s.d_{f}, 0), 0)')} AS {f}" for f in ORDER_FEATURES
    )
    state = ", ".join(
        f"{intercept.format(f)}::DOUBLE AS i_{f}, {spread.format(f)}::DOUBLE AS d_{f}" for f in ORDER_FEATURES
    )
    return f"WITH {OM}, s AS (SELECT {state} FROM om) SELECT case_id, label, {cells} FROM om, s"


def _normalized(spark, sf, method):
    df, spec = t.orders_matrix(spark, sf)
    out = normalize.apply_normalizer(df, spec, normalize.fit_normalizer(df, spec, method))
    return out.select(*spec.keys, *[rounded(f).alias(f) for f in spec.features])


@query("normalize_none", f"WITH {OM} SELECT * FROM om")
def normalize_none(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    return normalize.apply_normalizer(df, spec, normalize.fit_normalizer(df, spec, "None"))


@query("normalize_minmax", _scaled_sql("min({0})", "(max({0}) - min({0}))"))
def normalize_minmax(spark, sf):
    return _normalized(spark, sf, "MinMax")


@query("normalize_zscore", _scaled_sql("avg({0})", "stddev_pop({0})"))
def normalize_zscore(spark, sf):
    return _normalized(spark, sf, "Zscore")


@query("normalize_mean", _scaled_sql("avg({0})", "(max({0}) - min({0}))"))
def normalize_mean(spark, sf):
    return _normalized(spark, sf, "Mean")


_TRAIN = "o_orderstatus <> 'P'"


@query(
    "normalize_fit_on_train",
    f"""WITH {OM}, side AS (SELECT o_orderkey::VARCHAR AS case_id, o_orderstatus FROM orders),
m AS (SELECT om.*, o_orderstatus, 7.0::DOUBLE AS same FROM om JOIN side ON om.case_id = side.case_id),
s AS (SELECT avg(total) AS mt, stddev_pop(total) AS st, avg(lines) AS ml, stddev_pop(lines) AS sl FROM m WHERE {_TRAIN})
SELECT case_id, label, {r('(lines - ml) / sl')} AS lines, 0.0::DOUBLE AS same, {r('(total - mt) / st')} AS total FROM m, s""",
)
def normalize_fit_on_train(spark, sf):
    """Fitted on the training side only, applied to all; a constant feature maps to zero."""
    df, spec = t.orders_matrix(spark, sf)
    df = df.withColumn("same", F.lit(7.0))
    spec = spec.only(["lines", "same", "total"])
    train_ids = t.table(spark, sf, "orders").filter(_TRAIN).select(F.col("o_orderkey").cast("string").alias("case_id"))
    state = normalize.fit_normalizer(df.join(train_ids, "case_id", "left_semi"), spec, "Zscore")
    out = normalize.apply_normalizer(df, spec, state)
    return out.select(*spec.keys, *[rounded(f).alias(f) for f in spec.features])


@query(
    "l2_column_norms",
    f"WITH {OM} SELECT case_id, label, "
    + ", ".join(r(f"1000 * {f} / sqrt(sum({f} * {f}) OVER ())") + f" AS {f}" for f in ("lines", "qty_sum", "total"))
    + " FROM om",
)
def l2_column_norms(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_sum", "total"])
    out = normalize.apply_l2(df, spec, normalize.l2_norms(df, spec))
    return out.select(*spec.keys, *[rounded(F.col(f) * 1000).alias(f) for f in spec.features])


@query("pca_components")
def pca_components(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    scaled = normalize.apply_normalizer(df, spec, normalize.fit_normalizer(df, spec, "Zscore"))
    return reduce.apply_pca(scaled, spec, reduce.fit_pca(scaled, spec))[0]


@query(
    "pca_variance_shares",
    f"""WITH {OM}, c AS (SELECT var_samp(lines) AS a, var_samp(qty_avg) AS b, covar_samp(lines, qty_avg) AS c FROM om),
e AS (SELECT (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS e1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS e2 FROM c)
SELECT 'PCA_feature_1' AS component, {r('e1 / (e1 + e2)')} AS share FROM e UNION ALL
SELECT 'PCA_feature_2', {r('e2 / (e1 + e2)')} FROM e""",
)
def pca_variance_shares(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_avg"])
    state = reduce.fit_pca(df, spec)
    rows = [{"component": f"PCA_feature_{i + 1}", "share": v} for i, v in enumerate(state["variance"])]
    return normalize.state_table(spark, rows).select("component", rounded("share").alias("share"))


def _greedy_sql(cte, feats, label, threshold):
    """The filter as a recursion over the features in order; the kept list is an array."""
    pairs = " UNION ALL ".join(
        f"SELECT {i + 1} AS i, {j + 1} AS j, abs(corr({feats[i]}, {feats[j]})) AS c FROM {cte}"
        for i in range(len(feats))
        for j in range(i)
    )
    target = " UNION ALL ".join(f"SELECT {i + 1} AS i, '{f}' AS f, abs(corr({f}, {label})) AS c FROM {cte}" for i, f in enumerate(feats))
    return f"""pairs AS MATERIALIZED ({pairs}), target AS MATERIALIZED ({target}),
walk(i, kept) AS (SELECT 1, [1] UNION ALL
 SELECT n.i, CASE WHEN n.rival IS NULL THEN list_append(n.kept, n.i)
   WHEN (SELECT c FROM target WHERE target.i = n.i) > (SELECT c FROM target WHERE target.i = n.kept[n.rival])
     THEN list_concat(list_concat(n.kept[:n.rival - 1], [n.i]), n.kept[n.rival + 1:]) ELSE n.kept END
 FROM (SELECT w.i + 1 AS i, w.kept, (SELECT min(list_position(w.kept, p.j)) FROM pairs p
   WHERE p.i = w.i + 1 AND p.c > {threshold} AND list_contains(w.kept, p.j)) AS rival
   FROM walk w WHERE w.i < {len(feats)}) n)"""


@query(
    "pearson_filter",
    f"WITH RECURSIVE {OM}, {_greedy_sql('om', ORDER_FEATURES, 'label', 0.7)}, "
    f"last AS (SELECT kept FROM walk WHERE i = {len(ORDER_FEATURES)}) "
    "SELECT f AS feature, list_contains((SELECT kept FROM last), target.i) AS kept FROM target",
)
def pearson_filter(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    kept = set(reduce.pearson_filter(df, spec, 0.7))
    return normalize.state_table(spark, [{"feature": f, "kept": f in kept} for f in spec.features])


@query(
    "pearson_filter_survival",
    f"WITH RECURSIVE {OS}, {_greedy_sql('os', ORDER_FEATURES, 'event', 0.9)}, "
    f"last AS (SELECT kept FROM walk WHERE i = {len(ORDER_FEATURES)}) "
    "SELECT f AS feature, list_contains((SELECT kept FROM last), target.i) AS kept FROM target",
)
def pearson_filter_survival(spark, sf):
    df, spec = t.orders_survival(spark, sf)
    kept = set(reduce.pearson_filter(df, spec, 0.9))
    return normalize.state_table(spark, [{"feature": f, "kept": f in kept} for f in spec.features])


@query("no_reducer_survival", f"WITH {OS} SELECT * FROM os")
def no_reducer_survival(spark, sf):
    df, spec = t.orders_survival(spark, sf)
    reduce.check_features(spec, ORDER_FEATURES)
    return df


@query(
    "inflation_table",
    f"""WITH {OM}, c AS (SELECT corr(lines, qty_avg) AS ab, corr(lines, total) AS ac, corr(qty_avg, total) AS bc FROM om),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c),
v AS (SELECT 'lines' AS feature, (1 - bc * bc) / det AS vif FROM d UNION ALL
 SELECT 'qty_avg', (1 - ac * ac) / det FROM d UNION ALL SELECT 'total', (1 - ab * ab) / det FROM d)
SELECT feature, {r('vif')} AS vif, {r('1 / vif')} AS tolerance FROM v""",
)
def inflation_table(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    rows = reduce.inflation_table(df, spec.only(["lines", "qty_avg", "total"]))
    return normalize.state_table(spark, rows).select(
        "feature", rounded("vif").alias("vif"), rounded("tolerance").alias("tolerance")
    )


@query(
    "vif_filter",
    f"WITH {OM}, c AS (SELECT 1 / (1 - corr(qty_sum, lines) ** 2) AS vif FROM om) "
    "SELECT f AS feature, (SELECT vif FROM c) <= 3 AS kept FROM (VALUES ('lines'), ('qty_sum')) v(f)",
)
def vif_filter(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_sum"])
    kept = set(reduce.vif_filter(df, spec, 3.0))
    return normalize.state_table(spark, [{"feature": f, "kept": f in kept} for f in spec.features])


@query("feature_clusters")
def feature_clusters(spark, sf):
    df, spec = t.embeddings_matrix(spark, sf)
    g = gram.feature_gram(df, spec, scaling="minmax")
    labels = gram.cluster_features(g, 6)
    chosen = set(gram.representatives(g, labels))
    return normalize.state_table(
        spark,
        [{"feature": f, "cluster": int(c), "is_representative": f in chosen} for f, c in zip(g.names, labels)],
    )


@query("feature_cluster_sweep")
def feature_cluster_sweep(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    return normalize.state_table(spark, gram.cluster_sweep(gram.feature_gram(df, spec, scaling="minmax")))
