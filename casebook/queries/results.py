"""Queries on an exploration result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.plans import results as res
from casebook.queries import query
from casebook.queries.sql import RT, r
from casebook.sources import tables as t

DIMS = ["normalizer", "selector", "n_features", "classifier"]
FAMILY = ["normalizer", "selector", "classifier"]


@query(
    "choice_combinations",
    f"WITH {RT} SELECT * FROM (SELECT DISTINCT normalizer FROM rt), (SELECT DISTINCT selector FROM rt), "
    "(SELECT DISTINCT n_features FROM rt), (SELECT DISTINCT classifier FROM rt)",
)
def choice_combinations(spark, sf):
    return res.choices_from(t.results_table(spark, sf), DIMS)


@query(
    "slice_one_axis",
    f"WITH {RT} SELECT n_features, auc, std FROM rt WHERE normalizer = 'A' AND selector = 'F' AND classifier = 'c2' ORDER BY 1",
)
def slice_one_axis(spark, sf):
    fixed = {"normalizer": "A", "selector": "F", "classifier": "c2"}
    return res.slice_axis(t.results_table(spark, sf), fixed, "n_features")


@query(
    "splits_side_by_side",
    f"WITH {RT} SELECT normalizer, n_features, classifier, max(auc) FILTER (WHERE selector = 'F') AS \"F\", "
    "max(auc) FILTER (WHERE selector = 'O') AS \"O\" FROM rt GROUP BY 1, 2, 3",
)
def splits_side_by_side(spark, sf):
    df = t.results_table(spark, sf).withColumnRenamed("selector", "split")
    return res.splits_side_by_side(df, ["normalizer", "n_features", "classifier"], ["F", "O"])


@query(
    "best_feature_number",
    f"WITH {RT} SELECT normalizer, selector, classifier, n_features, auc FROM rt "
    "QUALIFY row_number() OVER (PARTITION BY normalizer, selector, classifier ORDER BY auc DESC, n_features) = 1",
)
def best_feature_number(spark, sf):
    return res.best_number(t.results_table(spark, sf), FAMILY)


_ONE_SE = f"""{RT}, best AS (SELECT normalizer, selector, classifier, auc - std AS floor_auc FROM rt
 QUALIFY row_number() OVER (PARTITION BY normalizer, selector, classifier ORDER BY auc DESC, n_features) = 1),
ose AS (SELECT rt.* FROM rt JOIN best USING (normalizer, selector, classifier) WHERE auc >= floor_auc
 QUALIFY row_number() OVER (PARTITION BY normalizer, selector, classifier ORDER BY n_features) = 1)"""


@query("one_standard_error", f"WITH {_ONE_SE} SELECT normalizer, selector, classifier, n_features, auc, std FROM ose")
def one_standard_error(spark, sf):
    return res.one_standard_error(t.results_table(spark, sf), FAMILY)


@query(
    "models_near_the_best",
    f"""WITH {_ONE_SE}, c AS (SELECT *, auc - 1.96::DOUBLE * std AS ci_low, auc + 1.96::DOUBLE * std AS ci_high FROM ose),
b AS (SELECT ci_low AS lo, ci_high AS hi FROM c ORDER BY auc DESC, normalizer DESC, selector DESC, classifier DESC LIMIT 1)
SELECT normalizer, selector, classifier, n_features, auc FROM c, b WHERE auc BETWEEN lo AND hi""",
)
def models_near_the_best(spark, sf):
    one = res.one_standard_error(t.results_table(spark, sf), FAMILY)
    ci = one.withColumn("ci_low", F.col("auc") - 1.96 * F.col("std")).withColumn(
        "ci_high", F.col("auc") + 1.96 * F.col("std")
    )
    return res.near_the_best(ci, tie=FAMILY).select(*FAMILY, "n_features", "auc")


@query(
    "interval_from_text",
    f"WITH {RT}, x AS (SELECT normalizer, selector, n_features, classifier, printf('[%.4f-%.4f]', sqrt(auc), sqrt(auc) + std) AS ci FROM rt) "
    "SELECT *, regexp_extract_all(ci, '\\d+\\.?\\d*')[1]::DOUBLE AS ci_low, regexp_extract_all(ci, '\\d+\\.?\\d*')[2]::DOUBLE AS ci_high FROM x",
)
def interval_from_text(spark, sf):
    df = t.results_table(spark, sf)
    text = df.select(*DIMS, F.format_string("[%.4f-%.4f]", F.sqrt("auc"), F.sqrt("auc") + F.col("std")).alias("ci"))
    return res.interval_from_text(text, "ci")


@query("sorted_results", f"WITH {RT} SELECT * FROM rt ORDER BY auc DESC")
def sorted_results(spark, sf):
    return res.sorted_by(t.results_table(spark, sf), "auc", ascending=False)


@query(
    "model_names",
    f"WITH {RT} SELECT normalizer || '_' || selector || '_' || n_features || '_' || classifier AS name, "
    "normalizer || '_' || selector || '_' || classifier AS short_name, n_features, classifier FROM rt",
)
def model_names(spark, sf):
    named = res.with_name(t.results_table(spark, sf), DIMS)
    parsed = res.from_name(named.select("name"), DIMS)
    return res.without_level(parsed, "n_features", DIMS).select("name", "short_name", "n_features", "classifier")
