"""Loading, matching and feature production."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import cleaning, firstorder
from casebook.queries import query
from casebook.queries.sql import DM, ME, OM, OS, r
from casebook.sources import matching, matrix_io
from casebook.sources import tables as t


@query("load_matrix", f"WITH {OM} SELECT * FROM om")
def load_matrix(spark, sf):
    df, _ = t.orders_matrix(spark, sf)
    return matrix_io.case_matrix(df)[0]


@query(
    "load_without_label",
    "SELECT p_partkey::VARCHAR AS case_id, 0 AS label, p_retailprice AS p_retailprice, p_size::DOUBLE AS p_size FROM part",
)
def load_without_label(spark, sf):
    raw = t.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return matrix_io.case_matrix(raw, emulate_label=True)[0]


@query(
    "load_without_case_id",
    "SELECT l_quantity, l_tax, l_returnflag, copy FROM (SELECT l_quantity, l_tax, l_returnflag, "
    "row_number() OVER (PARTITION BY l_quantity, l_tax, l_returnflag) AS copy FROM lineitem)",
)
def load_without_case_id(spark, sf):
    raw = t.table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_returnflag")
    keyed = matrix_io.keyed_by_content(raw)
    return keyed.select(
        "l_quantity", "l_tax", "l_returnflag", F.element_at(F.split("case_id", "-"), -1).cast("bigint").alias("copy")
    )


@query("load_survival_matrix", f"WITH {OS} SELECT * FROM os")
def load_survival_matrix(spark, sf):
    df, _ = t.orders_survival(spark, sf)
    return matrix_io.survival_matrix(df, "event", "duration", "case_id")[0]


URL_RULES = [
    matching.NameRule("english", include=("/en/",), exclude=("page=",)),
    matching.NameRule("german", include=("/de/",)),
    matching.NameRule("paged", include=("page=",), suffix="1"),
    matching.NameRule("plain", exclude=("page=", "/en/", "/de/")),
]


def _rule_sql(rule):
    parts = [f"contains(url, '{k}')" for k in rule.include] + [f"NOT contains(url, '{k}')" for k in rule.exclude]
    if rule.suffix:
        parts.append(f"ends_with(url, '{rule.suffix}')")
    hit = " AND ".join(parts)
    return (
        f"SELECT split_part(url, '/', 3) AS \"case\", '{rule.series}' AS series, "
        f"count(*) FILTER (WHERE {hit}) AS n_candidates, "
        f"CASE WHEN count(*) FILTER (WHERE {hit}) = 1 THEN min(url) FILTER (WHERE {hit}) END AS path, "
        f"CASE WHEN count(*) FILTER (WHERE {hit}) <> 1 THEN 'Can not match' END AS error FROM pages GROUP BY 1"
    )


@query("match_series_names", " UNION ALL ".join(_rule_sql(x) for x in URL_RULES))
def match_series_names(spark, sf):
    pages = t.table(spark, sf, "pages").select("url", F.split("url", "/")[2].alias("host"))
    return matching.match_names(pages, "host", "url", "url", URL_RULES)


PART_RULES = [
    matching.NameRule("blue", include=("blue",)),
    matching.NameRule("not_small", include=("a", "e"), exclude=("small",)),
]


@query(
    "match_without_suffix",
    " UNION ALL ".join(
        _rule_sql(x).replace("split_part(url, '/', 3)", "p_brand").replace("url", "p_name").replace("pages", "part")
        for x in PART_RULES
    ),
)
def match_without_suffix(spark, sf):
    return matching.match_names(t.table(spark, sf, "part"), "p_brand", "p_name", "p_name", PART_RULES)


_FO = [
    ("energy", "sum(value * value)"),
    ("minimum", "min(value)"),
    ("maximum", "max(value)"),
    ("value_range", "max(value) - min(value)"),
    ("mean", "avg(value)"),
    ("percentile10", "quantile_cont(value, 0.1)"),
    ("percentile25", "quantile_cont(value, 0.25)"),
    ("median", "quantile_cont(value, 0.5)"),
    ("percentile75", "quantile_cont(value, 0.75)"),
    ("percentile90", "quantile_cont(value, 0.9)"),
    ("interquartile_range", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"),
    ("root_mean_square", "sqrt(avg(value * value))"),
]
_FO_SQL = f"""
WITH {ME},
g AS (SELECT case_id, series, count(*) AS n, {', '.join(f'{e} AS {k}' for k, e in _FO)} FROM me GROUP BY 1, 2),
c AS (SELECT me.case_id, me.series, avg(abs(value - mean)) AS mad, avg((value - mean) ** 2) AS variance,
  avg((value - mean) ** 3) AS m3, avg((value - mean) ** 4) AS m4,
  avg(value) FILTER (WHERE value BETWEEN percentile10 AND percentile90) AS rmean
  FROM me JOIN g ON me.case_id = g.case_id AND me.series = g.series GROUP BY 1, 2),
q AS (SELECT me.case_id, me.series, avg(abs(value - rmean)) FILTER (WHERE value BETWEEN percentile10 AND percentile90) AS rmad
  FROM me JOIN g ON me.case_id = g.case_id AND me.series = g.series JOIN c ON me.case_id = c.case_id AND me.series = c.series
  GROUP BY 1, 2)
SELECT g.case_id, g.series, n, {', '.join(f'{r("g." + k)} AS {k}' for k, _ in _FO)},
 {r('mad', 10)} AS mean_absolute_deviation, {r('rmad', 10)} AS robust_mean_absolute_deviation,
 {r('variance')} AS variance,
 {r('CASE WHEN variance > 0 THEN m3 / variance ** 1.5 ELSE 0 END')} AS skewness,
 {r('CASE WHEN variance > 0 THEN m4 / variance ** 2 ELSE 0 END')} AS kurtosis
FROM g JOIN c ON g.case_id = c.case_id AND g.series = c.series JOIN q ON g.case_id = q.case_id AND g.series = q.series
"""


@query("first_order_statistics", _FO_SQL)
def first_order_statistics(spark, sf):
    deviations = {"mean_absolute_deviation": 10, "robust_mean_absolute_deviation": 10}
    return firstorder.rounded_stats(firstorder.first_order(t.measurements(spark, sf)), 8, deviations)


_BIN = "least(15, floor((value - lo) / nullif(hi - lo, 0) * 16))::INT"
_HIST_SQL = f"""
WITH {ME},
b AS (SELECT case_id, series, min(value) AS lo, max(value) AS hi FROM me GROUP BY 1, 2),
h AS (SELECT me.case_id, me.series, coalesce({_BIN}, 0) AS bin, count(*)::DOUBLE AS n
  FROM me JOIN b ON me.case_id = b.case_id AND me.series = b.series GROUP BY 1, 2, 3),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id, series) AS p FROM h)
SELECT case_id, series, {r('-sum(p * log2(p))')} AS entropy, {r('sum(p * p)')} AS uniformity FROM p GROUP BY 1, 2
"""


@query("histogram_entropy", _HIST_SQL)
def histogram_entropy(spark, sf):
    h = firstorder.histogram_features(t.measurements(spark, sf), bin_count=16)
    return h.select("case_id", "series", rounded("entropy").alias("entropy"), rounded("uniformity").alias("uniformity"))


@query(
    "histogram_entropy_by_width",
    _HIST_SQL.replace(f"coalesce({_BIN}, 0)", "(floor(value / 25) - floor(lo / 25))::INT"),
)
def histogram_entropy_by_width(spark, sf):
    h = firstorder.histogram_features(t.measurements(spark, sf), bin_width=25.0)
    return h.select("case_id", "series", rounded("entropy").alias("entropy"), rounded("uniformity").alias("uniformity"))


@query(
    "normalize_and_resegment",
    f"""WITH {ME},
m AS (SELECT case_id, avg(value) AS mu FROM me GROUP BY 1),
s AS (SELECT me.case_id, min(mu) AS mu, sqrt(avg((value - mu) ** 2)) AS sd FROM me JOIN m ON me.case_id = m.case_id GROUP BY 1),
z AS (SELECT me.case_id, series, (value - mu) / sd * 100 AS value FROM me JOIN s ON me.case_id = s.case_id WHERE sd > 0),
k AS (SELECT case_id, series, avg(value) AS mu, stddev_pop(value) AS sd FROM z GROUP BY 1, 2),
f AS (SELECT z.* FROM z JOIN k ON z.case_id = k.case_id AND z.series = k.series
  WHERE z.value BETWEEN k.mu - 2 * k.sd - 1e-9 AND k.mu + 2 * k.sd + 1e-9)
SELECT case_id, series, count(*) AS n, {r('avg(value)')} AS mean FROM f GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def normalize_and_resegment(spark, sf):
    m = firstorder.normalized(t.measurements(spark, sf), scale=100.0)
    m = firstorder.resegmented_sigma(m, 2.0)
    m = firstorder.large_enough(m, 5)
    return m.groupBy("case_id", "series").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias("mean"))


@query(
    "extract_with_errors",
    f"""WITH {ME}, g AS (SELECT case_id, count(DISTINCT series) AS s, min(n) AS least FROM
 (SELECT case_id, series, count(*) AS n FROM me GROUP BY 1, 2) GROUP BY 1)
SELECT case_id, CASE WHEN s < 5 THEN 'missing series' WHEN least < 6 THEN 'too few measurements' ELSE 'ok' END AS reason,
 CASE WHEN s < 5 OR least < 6 THEN 0 ELSE 60 END AS n_features FROM g""",
)
def extract_with_errors(spark, sf):
    """Cases that cannot be extracted go to the error table with a reason; the others get all columns."""
    features, errors = firstorder.extract(
        t.measurements(spark, sf), series=["click", "error", "purchase", "signup", "view"], minimum=6
    )
    width = len([c for c in features.columns if c != "case_id"])
    filled = features.select(
        "case_id", F.lit("ok").alias("reason"), F.lit(width).alias("n_features")
    )
    return filled.unionByName(errors.select("case_id", "reason", F.lit(0).alias("n_features")))


_SERIES = ("click", "error", "purchase", "signup", "view")
_EXTRACTED = [f"{s}_{k}" for s in _SERIES for k in ("maximum", "mean")]


@query(
    "extraction_table",
    f"""WITH {ME}, g AS (SELECT case_id, series, max(value) AS maximum, {r('avg(value)')} AS mean FROM me GROUP BY 1, 2
 HAVING count(*) >= 6),
w AS (SELECT case_id, count(*) AS s, {', '.join(f"max(CASE WHEN series = '{s}' THEN {k} END) AS {s}_{k}" for s in _SERIES for k in ('maximum', 'mean'))}
 FROM g GROUP BY 1),
q AS (SELECT case_id, count(DISTINCT value)::DOUBLE AS v FROM me GROUP BY 1),
l AS (SELECT c_custkey::VARCHAR AS case_id, (c_acctbal > 0)::INT AS label FROM customer),
a AS (SELECT q.case_id, label, CASE WHEN s IS NULL OR s < 5 THEN 'missing features' WHEN label IS NULL THEN 'no label' ELSE 'ok' END AS reason,
 q.v, w.* EXCLUDE (case_id, s) FROM q LEFT JOIN w USING (case_id) LEFT JOIN l USING (case_id))
SELECT case_id, reason, {', '.join(f"CASE WHEN reason = 'ok' THEN {c} END AS {c}" for c in ['label', *_EXTRACTED])},
 CASE WHEN reason = 'ok' THEN v END AS Quality_distinct FROM a""",
)
def extraction_table(spark, sf):
    """Extracted and quality features with labels, and the cases that cannot be used with the reason."""
    me = t.measurements(spark, sf)
    stats = me.groupBy("case_id", "series").agg(
        F.max("value").alias("maximum"),
        rounded(F.avg("value")).alias("mean"),
        F.count(F.lit(1)).cast("double").alias("diagnostics_n"),
    )
    long = stats.filter(F.col("diagnostics_n") >= 6).unpivot(
        ["case_id", "series"], ["maximum", "mean", "diagnostics_n"], "statistic", "value"
    )
    features = long.select("case_id", F.concat_ws("_", "series", "statistic").alias("feature"), "value")
    quality = me.groupBy("case_id").agg(F.count_distinct("value").alias("value")).withColumn("name", F.lit("distinct"))
    labels = t.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), (F.col("c_acctbal") > 0).cast("int").alias("label")
    )
    good, errors = firstorder.extraction_table(
        features, quality, labels, columns=[*_EXTRACTED, f"{firstorder.QUALITY}distinct"]
    )
    return good.withColumn("reason", F.lit("ok")).unionByName(errors, allowMissingColumns=True)


_NAMES = """names AS (SELECT p_partkey AS position,
 p_brand || '_original_' || replace(split_part(p_type, ' ', 1), '_', '') || '_' ||
 upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) ||
 upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS feature FROM part)"""


@query(
    "feature_name_parts",
    f"""WITH {_NAMES},
s AS (SELECT position, feature, string_split(feature, '_') AS sep FROM names),
p AS (SELECT position, feature, sep[1] AS seq, sep[2] AS image, sep[-2] AS class, sep[-1] AS last,
  regexp_extract_all(sep[-1], '[A-Z]') AS caps FROM s),
g AS (SELECT position, feature, CASE WHEN length(last) <= 5 THEN last WHEN len(caps) <= 1 THEN left(last, 5)
  ELSE array_to_string(caps, '') END AS short_name,
  CASE WHEN min(seq) OVER () = max(seq) OVER () THEN '' ELSE seq END || '-' ||
  CASE WHEN min(image) OVER () = max(image) OVER () THEN '' ELSE image END || '-' ||
  CASE WHEN min(class) OVER () = max(class) OVER () THEN '' ELSE class END AS group_name FROM p),
f AS (SELECT *, min(position) OVER (PARTITION BY group_name) AS first_at FROM g)
SELECT position, feature, short_name, group_name, (dense_rank() OVER (ORDER BY first_at) - 1)::INT AS group_index FROM f""",
)
def feature_name_parts(spark, sf):
    word = lambda i: F.initcap(F.split("p_name", " ")[i])
    part = t.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    names = part.select(
        F.col("p_partkey").alias("position"),
        F.concat_ws(
            "_",
            "p_brand",
            F.lit("original"),
            F.split("p_type", " ")[0],
            F.concat(word(0), word(1)),
        ).alias("feature"),
    )
    return cleaning.feature_name_parts(names)


@query("text_feature_matrix", f"WITH {DM} SELECT * EXCLUDE (lang, source, toxic) FROM dm")
def text_feature_matrix(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return spec.project(df)
