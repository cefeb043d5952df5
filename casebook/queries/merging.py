"""Joins and set operations on matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import merging as m
from casebook.queries import query
from casebook.queries.sql import DM, OM, RA
from casebook.sources import tables as t
from casebook.spec import MatrixSpec


@query(
    "merge_features",
    f"WITH {RA} SELECT ra.case_id, ra.disc AS odd_disc, ra.price AS odd_price, ra.qty AS odd_qty, "
    "rb.disc AS even_disc, rb.price AS even_price, rb.qty AS even_qty FROM ra JOIN rb ON ra.case_id = rb.case_id",
)
def merge_features(spark, sf):
    a, b, spec = t.rater_pairs(spark, sf)
    ids = a.join(b, "case_id", "left_semi").select("case_id")  # parts rated by both sides
    a, b = a.join(ids, "case_id", "left_semi"), b.join(ids, "case_id", "left_semi")
    return m.merge_features(a, spec, b, spec, prefixes=("odd", "even"))[0]


@query(
    "merge_cases",
    "SELECT 'c' || c_custkey AS case_id, c_acctbal AS balance FROM customer UNION ALL "
    "SELECT 's' || s_suppkey, s_acctbal FROM supplier",
)
def merge_cases(spark, sf):
    c = t.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("case_id"), F.col("c_acctbal").alias("balance")
    )
    s = t.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("case_id"), F.col("s_acctbal").alias("balance")
    )
    return m.merge_cases(c, s, MatrixSpec(("balance",), label=None))


@query(
    "attach_clinical",
    f"WITH {DM} SELECT case_id, label, words, n_chars, lang, source FROM dm",
)
def attach_clinical(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    side = t.docs_clinical(spark, sf).select("case_id", "lang", "source", F.col("toxic").alias("Label"))
    spec = spec.only(["n_chars", "words"])
    return m.attach_clinical(spec.project(df), side, spec)


@query(
    "key_difference",
    "SELECT o_orderkey::VARCHAR AS case_id, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) "
    "UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, 'right' FROM lineitem WHERE l_orderkey NOT IN "
    "(SELECT o_orderkey FROM orders)",
)
def key_difference(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"))
    li = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id")).distinct()
    return m.key_difference(o, li)


@query(
    "train_and_test_features_agree",
    f"WITH {OM} SELECT true AS same_features, false AS same_after_drop, count(*) AS cases FROM om",
)
def train_and_test_features_agree(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    other = MatrixSpec.infer(df.select(*reversed(df.columns)))
    checks = (m.same_features(spec, other), m.same_features(spec, other.only(other.features[1:])))
    return df.agg(
        F.lit(checks[0]).alias("same_features"), F.lit(checks[1]).alias("same_after_drop"), F.count(F.lit(1)).alias("cases")
    )


_REF = "SELECT o_orderkey::VARCHAR AS case_id FROM orders WHERE o_orderstatus = 'P'"


@query(
    "split_by_reference",
    f"WITH {OM}, ref AS ({_REF}) SELECT case_id, label, CASE WHEN case_id IN (SELECT case_id FROM ref) THEN 'test' "
    "ELSE 'train' END AS side FROM om",
)
def split_by_reference(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    ref = t.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("string").alias("case_id")
    )
    ref = ref.join(df, "case_id", "left_semi")
    train, test = m.split_by_reference(df, ref, spec)
    pick = lambda d, side: d.select("case_id", "label", F.lit(side).alias("side"))
    return pick(train, "train").unionByName(pick(test, "test"))


@query(
    "restrict_curves",
    "SELECT l_orderkey::VARCHAR AS case_id, l_linenumber AS step, l_discount AS surv FROM lineitem WHERE l_orderkey IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')",
)
def restrict_curves(spark, sf):
    li = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.col("l_linenumber").alias("step"),
        F.col("l_discount").alias("surv"),
        "l_linestatus",
    )
    train = li.filter("l_linestatus = 'F'").drop("l_linestatus")
    test = li.filter("l_linestatus <> 'F'").drop("l_linestatus")
    cases = t.table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1")).select(
        F.col("o_orderkey").cast("string").alias("case_id")
    )
    return m.restrict_curves(train, test, cases, check=False)


@query(
    "interpolated_lookup",
    """WITH p AS (SELECT user_id::VARCHAR AS case_id, date_diff('second', TIMESTAMP '2024-01-01', ts)::DOUBLE AS time,
 avg(value) AS value FROM events GROUP BY 1, 2),
 ends AS (SELECT min(time) AS lo, max(time) AS hi FROM p),
 g AS (SELECT lo + (hi - lo) * i / 19 AS time FROM ends, range(20) t(i)),
 c AS (SELECT DISTINCT case_id FROM p),
 j AS (SELECT c.case_id, g.time,
   (SELECT max(p.time) FROM p WHERE p.case_id = c.case_id AND p.time <= g.time) AS t0,
   (SELECT min(p.time) FROM p WHERE p.case_id = c.case_id AND p.time >= g.time) AS t1 FROM c, g)
SELECT j.case_id, (round(j.time, 3) + 0.0::DOUBLE) AS time, (round(CASE WHEN t0 IS NULL THEN b.value
  WHEN t1 IS NULL THEN a.value WHEN t0 = t1 THEN a.value
  ELSE a.value + (b.value - a.value) * (j.time - t0) / (t1 - t0) END, 6) + 0.0::DOUBLE) AS value
FROM j LEFT JOIN p a ON a.case_id = j.case_id AND a.time = t0 LEFT JOIN p b ON b.case_id = j.case_id AND b.time = t1""",
)
def interpolated_lookup(spark, sf):
    from casebook.functions.exprs import rounded
    from casebook.operators.curves import interpolate_on_grid

    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    p = (
        t.table(spark, sf, "events")
        .groupBy(F.col("user_id").cast("string").alias("case_id"), seconds.cast("double").alias("time"))
        .agg(F.avg("value").alias("value"))
    )
    ends = p.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).head()
    grid = [ends.lo + (ends.hi - ends.lo) * i / 19 for i in range(20)]
    out = interpolate_on_grid(p, ["case_id"], "time", "value", grid)
    return out.select("case_id", rounded("time", 3).alias("time"), rounded("value", 6).alias("value"))
