"""Column choice, validity and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import cleaning as c
from casebook.queries import query
from casebook.queries.sql import DIRTY, DM, OM, OML, r
from casebook.sources import tables as t
from casebook.sources.tables import ORDER_FEATURES

_BAD = "(try_cast({0} AS DOUBLE) IS NULL OR isnan(try_cast({0} AS DOUBLE)) OR isinf(try_cast({0} AS DOUBLE)))"
_DIRTY_FEATURES = ("a_qty", "b_disc", "c_tax", "constant", "lines", "mostly")
_ANY_BAD = " OR ".join(_BAD.format(f) for f in _DIRTY_FEATURES)


@query(
    "select_features_by_index",
    f"WITH {OM} SELECT case_id, label, {ORDER_FEATURES[0]}, {ORDER_FEATURES[2]}, {ORDER_FEATURES[5]} FROM om",
)
def select_features_by_index(spark, sf):
    return c.select_by_index(*t.orders_matrix(spark, sf), [5, 0, 2])[0]


@query("select_features_by_name", f"WITH {OM} SELECT case_id, label, total, lines FROM om")
def select_features_by_name(spark, sf):
    return c.select_by_name(*t.orders_matrix(spark, sf), ["total", "lines"])[0]


@query(
    "select_features_by_part",
    f"WITH {OM} SELECT case_id, label, qty_avg, qty_max, qty_std, qty_sum, tax_std, price_std, disc_std FROM om",
)
def select_features_by_part(spark, sf):
    return c.select_by_part(*t.orders_matrix(spark, sf), ["qty", "_std"])[0]


@query("drop_text_columns", "SELECT p_partkey::VARCHAR AS case_id, p_retailprice, p_size FROM part")
def drop_text_columns(spark, sf):
    from casebook.spec import MatrixSpec

    part = t.table(spark, sf, "part").withColumn("case_id", F.col("p_partkey").cast("string")).drop("p_partkey")
    return c.drop_text_columns(part, MatrixSpec.infer(part, label=None))[0]


@query(
    "near_constant_features",
    f"""WITH {DIRTY},
n AS (SELECT constant::DOUBLE AS constant, lines::DOUBLE AS lines, mostly::DOUBLE AS mostly FROM dirty),
u AS (SELECT feature, value FROM n UNPIVOT (value FOR feature IN (constant, lines, mostly))),
k AS (SELECT feature, value, count(*) AS n FROM u GROUP BY 1, 2)
SELECT feature, max(n) / sum(n) < 0.9 AS kept FROM k GROUP BY 1""",
)
def near_constant_features(spark, sf):
    df, spec = t.dirty_matrix(spark, sf)
    spec = spec.only(["constant", "lines", "mostly"])
    gone = c.near_constant(c.typed(df, spec), spec)
    return c.state_rows(spark, [{"feature": f, "kept": f not in gone} for f in spec.features])


@query(
    "mode_share",
    f"WITH {OM}, {OML}, k AS (SELECT feature, value, count(*) AS n FROM om_long GROUP BY 1, 2) "
    f"SELECT feature, {r('max(n) / sum(n)')} AS mode_share FROM k GROUP BY 1",
)
def mode_share(spark, sf):
    return c.mode_share(*t.orders_matrix(spark, sf)).select("feature", rounded("mode_share").alias("mode_share"))


@query(
    "plain_aggregates",
    f"""WITH {OM}, {OML} SELECT feature, count(*) AS n, {r('sum(value)', 3)} AS total, {r('avg(value)', 5)} AS mean,
{r('stddev_pop(value)', 5)} AS sd, min(value) AS low, max(value) AS high, count(DISTINCT value) AS n_distinct,
{r('quantile_cont(value, 0.25)', 4)} AS q1, {r('quantile_cont(value, 0.5)', 4)} AS median
FROM om_long GROUP BY 1""",
)
def plain_aggregates(spark, sf):
    from casebook.operators.stats import describe
    from casebook.sources import kept_tables

    d = describe(*kept_tables.orders_matrix(spark, sf))
    return d.select(
        "feature",
        "n",
        rounded("total", 3).alias("total"),
        rounded("mean", 5).alias("mean"),
        rounded("sd", 5).alias("sd"),
        "low",
        "high",
        "n_distinct",
        rounded("q1", 4).alias("q1"),
        rounded("median", 4).alias("median"),
    )


@query(
    "invalid_cell_counts",
    f"WITH {DIRTY} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {_BAD.format(f)}) AS n_invalid FROM dirty" for f in _DIRTY_FEATURES
    ),
)
def invalid_cell_counts(spark, sf):
    return c.invalid_counts(*t.dirty_matrix(spark, sf))


@query(
    "first_invalid_cell",
    f"WITH {DIRTY}, bad AS ("
    + " UNION ALL ".join(
        f"SELECT case_id, '{f}' AS feature FROM dirty WHERE {_BAD.format(f)}" for f in _DIRTY_FEATURES
    )
    + ") SELECT case_id, feature FROM bad ORDER BY case_id, feature LIMIT 1",
)
def first_invalid_cell(spark, sf):
    return c.first_invalid_cell(*t.dirty_matrix(spark, sf))


@query(
    "first_invalid_label",
    "SELECT min(c_custkey::VARCHAR) AS case_id FROM customer WHERE c_nationkey NOT IN (0, 1)",
)
def first_invalid_label(spark, sf):
    from casebook.spec import MatrixSpec

    df = t.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.col("c_nationkey").cast("string").alias("label"), "c_acctbal"
    )
    return c.first_invalid_label(df, MatrixSpec(("c_acctbal",)))


@query("drop_invalid_cases", f"WITH {DIRTY} SELECT * FROM dirty WHERE NOT ({_ANY_BAD})")
def drop_invalid_cases(spark, sf):
    return c.drop_invalid_cases(*t.dirty_matrix(spark, sf))


@query("drop_invalid_features", f"WITH {DIRTY} SELECT case_id, label, constant, lines, mostly FROM dirty")
def drop_invalid_features(spark, sf):
    return c.drop_invalid_features(*t.dirty_matrix(spark, sf))[0]


@query("export_invalid_block", f"WITH {DIRTY} SELECT case_id, a_qty, b_disc, c_tax FROM dirty WHERE {_ANY_BAD}")
def export_invalid_block(spark, sf):
    return c.invalid_block(*t.dirty_matrix(spark, sf))[0]


@query("label_counts", f"WITH {OM} SELECT label, count(*) AS n FROM om GROUP BY 1")
def label_counts(spark, sf):
    return c.label_counts(*t.orders_matrix(spark, sf))


@query(
    "binary_label_check",
    f"WITH {OM} SELECT min(label) = 0 AND max(label) = 1 AS is_binary, "
    "least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) >= 10 AS has_enough_cases FROM om",
)
def binary_label_check(spark, sf):
    return c.check_binary(*t.orders_matrix(spark, sf))


@query(
    "matrix_summary",
    f"WITH {OM} SELECT count(*) AS cases, {len(ORDER_FEATURES)}::BIGINT AS features, "
    "count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM om",
)
def matrix_summary(spark, sf):
    return c.summary(*t.orders_matrix(spark, sf))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot_encode",
    "SELECT o_orderkey::VARCHAR AS case_id, o_totalprice AS total, "
    + ", ".join(f"(o_orderstatus = '{v}')::INT AS \"o_orderstatus_{v}\"" for v in "FOP")
    + " FROM orders",
)
def one_hot_encode(spark, sf):
    o = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_totalprice").alias("total"), "o_orderstatus"
    )
    return c.one_hot(o, ["o_orderstatus"])


@query(
    "prefix_feature_names",
    f"WITH {OM} SELECT case_id, label, " + ", ".join(f"{f} AS t2_{f}" for f in ORDER_FEATURES) + " FROM om",
)
def prefix_feature_names(spark, sf):
    return c.prefixed(*t.orders_matrix(spark, sf), "t2")[0]


_CUTS = (20.0, 40.0, 100.0)
_CUT_SQL = [(f"qty_sum < {x:g}", f"qty_sum < {x}") for x in _CUTS] + [("qty_sum >= 100", "qty_sum >= 100")]


@query(
    "cut_point_groups",
    f"WITH {OM} " + " UNION ALL ".join(f"SELECT '{n}' AS cut_group, case_id FROM om WHERE {w}" for n, w in _CUT_SQL),
)
def cut_point_groups(spark, sf):
    return c.cut_groups(t.orders_matrix(spark, sf)[0], "qty_sum", _CUTS)


@query(
    "cut_point_groups_disjoint",
    f"WITH {OM} SELECT CASE " + " ".join(f"WHEN {w} THEN '{n}'" for n, w in _CUT_SQL) + " END AS cut_group, case_id FROM om",
)
def cut_point_groups_disjoint(spark, sf):
    return c.cut_groups(t.orders_matrix(spark, sf)[0], "qty_sum", _CUTS, disjoint=True)


@query("ordered_matrix", f"WITH {OM} SELECT * FROM om ORDER BY case_id")
def ordered_matrix(spark, sf):
    return c.ordered(*t.orders_matrix(spark, sf))
