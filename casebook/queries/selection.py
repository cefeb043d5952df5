"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import cleaning, normalize, select
from casebook.queries import ORACLES, query
from casebook.queries.sql import DIRTY, DM, EM, OM, OML, OS, r
from casebook.queries.splits import _dist2
from casebook.queries.tests_stat import RANKS
from casebook.sources import kept_tables as t
from casebook.sources.tables import DOC_FEATURES, ORDER_FEATURES


def _f_sql(source):
    return f"""g AS (SELECT feature, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label = 0)::DOUBLE AS n0,
 avg(value) FILTER (WHERE label = 1) AS m1, avg(value) FILTER (WHERE label = 0) AS m0,
 var_pop(value) FILTER (WHERE label = 1) AS v1, var_pop(value) FILTER (WHERE label = 0) AS v0 FROM {source} GROUP BY 1),
f AS (SELECT feature, n1 * n0 / (n1 + n0) * (m1 - m0) ** 2 / ((n1 * v1 + n0 * v0) / (n1 + n0 - 2)) AS f FROM g)"""


@query(
    "anova_top_features",
    f"""WITH {OM}, {OML}, {_f_sql('om_long')}
SELECT feature, {r('f', 6)} AS f, row_number() OVER (ORDER BY f DESC, feature)::INT AS rank_no FROM f
QUALIFY row_number() OVER (ORDER BY f DESC, feature) <= 10""",
)
def anova_top_features(spark, sf):
    """Matrix, near-constant filter, z-score, F scores, ten best features."""
    df, spec = t.orders_matrix(spark, sf)
    df, spec = cleaning.drop_near_constant(df, spec)
    df = normalize.apply_normalizer(df, spec, normalize.fit_normalizer(df, spec, "Zscore"))
    out = select.ranked(select.anova_scores(df, spec), spec).filter(F.col("rank_no") <= 10)
    return out.select("feature", rounded("score", 6).alias("f"), "rank_no")


@query(
    "kruskal_wallis_top_features",
    f"""WITH {RANKS}, h AS (SELECT feature, (12 / (t * (t + 1)) * (r1 * r1 / m + (t * (t + 1) / 2 - r1) ** 2 / k) - 3 * (t + 1))
 / (1 - ties / (t * t * t - t)) AS h FROM s)
SELECT feature, {r('h', 6)} AS h, row_number() OVER (ORDER BY h DESC, feature)::INT AS rank_no FROM h
QUALIFY row_number() OVER (ORDER BY h DESC, feature) <= 10""",
)
def kruskal_wallis_top_features(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    out = select.ranked(select.kruskal_scores(df, spec), spec).filter(F.col("rank_no") <= 10)
    return out.select("feature", rounded("score", 6).alias("h"), "rank_no")


def _relief_sql(anchor_filter="true"):
    norms = ", ".join(f"{f} / sqrt(sum({f} * {f}) OVER ()) AS {f}" for f in DOC_FEATURES)
    weights = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, sum(CASE WHEN a.label <> b.label THEN 1 ELSE -1 END * (a.{f} - b.{f}) ** 2) AS w "
        "FROM best JOIN x a ON best.a = a.case_id JOIN x b ON best.b = b.case_id"
        for f in DOC_FEATURES
    )
    return f"""WITH {DM}, x AS MATERIALIZED (SELECT case_id, label, row_number() OVER (ORDER BY case_id) AS pos, count(*) OVER () AS n, {norms} FROM dm),
best AS MATERIALIZED (SELECT a.case_id AS a, b.case_id AS b FROM x a JOIN x b ON a.case_id <> b.case_id WHERE {anchor_filter}
 QUALIFY row_number() OVER (PARTITION BY a.case_id, a.label = b.label ORDER BY {_dist2('a', 'b', DOC_FEATURES)}, b.case_id) = 1),
w AS ({weights}) SELECT feature, {r('w * 1000')} AS weight, row_number() OVER (ORDER BY abs(w) DESC, feature)::INT AS rank_no FROM w"""


@query("relief_top_features", _relief_sql())
def relief_top_features(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    out = select.ranked(select.relief_scores(df, spec), spec)
    return out.select("feature", rounded(F.col("weight") * 1000).alias("weight"), "rank_no")


@query("relief_part_of_cases", _relief_sql("a.pos <= floor(0.4 * a.n)"))
def relief_part_of_cases(spark, sf):
    """Relief with the iteration ratio at 0.4."""
    df, spec = t.docs_matrix(spark, sf)
    out = select.ranked(select.relief_scores(df, spec, ratio=0.4), spec)
    return out.select("feature", rounded(F.col("weight") * 1000).alias("weight"), "rank_no")


@query(
    "relieff_scores",
    f"""WITH {DM}, near AS MATERIALIZED (SELECT a.case_id AS a, b.case_id AS b FROM dm a JOIN dm b ON a.case_id <> b.case_id
 QUALIFY row_number() OVER (PARTITION BY a.case_id ORDER BY {_dist2('a', 'b', DOC_FEATURES)}, b.case_id) <= 100) """
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, sum(CASE WHEN a.label = b.label THEN 1 ELSE -1 END * CASE WHEN a.{f} = b.{f} THEN 1 ELSE -1 END)::BIGINT AS score "
        "FROM near JOIN dm a ON near.a = a.case_id JOIN dm b ON near.b = b.case_id"
        for f in DOC_FEATURES
    ),
)
def relieff_scores(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return select.relieff_scores(df, spec, neighbors=100)


@query("recursive_elimination")
def recursive_elimination(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(f for f in spec.features if f.endswith(("avg", "max")) or f == "lines")
    return normalize.state_table(spark, select.rfe_ranks(df, spec, 5))


@query(
    "mutual_information",
    f"""WITH {OM}, q AS (SELECT label, lines::INT AS lines, qty_max::INT // 10 AS qty_max, (tax_max * 100)::INT // 3 AS tax_max FROM om),
u AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM q" for a, b in
      [('lines', 'qty_max'), ('lines', 'tax_max'), ('lines', 'label'), ('qty_max', 'tax_max'), ('qty_max', 'label'), ('tax_max', 'label')])}),
c AS (SELECT a, b, x, y, count(*)::DOUBLE AS n FROM u GROUP BY 1, 2, 3, 4),
m AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b) AS t FROM c)
SELECT a, b, {r('sum(n / t * ln(n * t / (nx * ny)))')} AS mi FROM m GROUP BY 1, 2""",
)
def mutual_information(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    d = df.select(
        "case_id",
        "label",
        F.col("lines").cast("int").alias("lines"),
        F.floor(F.round("qty_max").cast("int") / 10).cast("int").alias("qty_max"),
        F.floor(F.round(F.col("tax_max") * 100).cast("int") / 3).cast("int").alias("tax_max"),
    )
    mi = select.mutual_information(d, spec.only(["lines", "qty_max", "tax_max"]))
    return mi.select("a", "b", rounded("mi").alias("mi"))


@query("mrmr_features")
def mrmr_features(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    return normalize.state_table(
        spark, [{"pick": i + 1, "feature": f} for i, f in enumerate(select.mrmr(df, spec, 6))]
    )


@query(
    "cluster_pick_single",
    f"WITH {OS}, c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, event)) AS r FROM os" for f in ORDER_FEATURES)
    + ") SELECT arg_max(feature, r) AS feature FROM c",
)
def cluster_pick_single(spark, sf):
    df, spec = t.orders_survival(spark, sf)
    return normalize.state_table(spark, [{"feature": f} for f in select.cluster_pick(df, spec, 1)])


@query("cluster_pick")
def cluster_pick(spark, sf):
    df, spec = t.orders_survival(spark, sf)
    return normalize.state_table(spark, [{"feature": f} for f in select.cluster_pick(df, spec, 4)])


@query("select_all", f"WITH {OS} SELECT * FROM os")
def select_all(spark, sf):
    df, spec = t.orders_survival(spark, sf)
    picked = spec.only(select.SELECTORS["All"](df, spec, 0))
    return picked.project(df)


@query(
    "selector_chain",
    f"SELECT (row_number() OVER (ORDER BY abs(t) DESC, feature) - 1)::INT AS position, feature FROM ({ORACLES['t_test']}) "
    f"SEMI JOIN ({ORACLES['kruskal_wallis_top_features']}) USING (feature) QUALIFY position < 4",
)
def selector_chain(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    picked = select.select_chain(df, spec, [("KW", 10), ("ANOVA", 4)])
    return normalize.state_table(spark, [{"position": i, "feature": f} for i, f in enumerate(picked.features)])


@query(
    "custom_selector",
    f"WITH {OM}, {OML}, v AS (SELECT feature, var_pop(value) AS v FROM om_long GROUP BY 1) "
    "SELECT feature FROM v ORDER BY v DESC LIMIT 3",
)
def custom_selector(spark, sf):
    """The extension point: any callable (df, spec, k) -> names."""
    from casebook.operators.stats import per_feature

    def most_variable(df, spec, k):
        v = per_feature(df, spec, {"score": F.var_pop})
        return select.top_features(v, spec, k)

    df, spec = t.orders_matrix(spark, sf)
    picked = select.select_chain(df, spec, [(most_variable, 3)])
    return normalize.state_table(spark, [{"feature": f} for f in picked.features])
