"""Splits, folds, balancing and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import over, rounded
from casebook.operators import balance, searches, splitting
from casebook.queries import query
from casebook.queries.sql import DM, OM, OS, r
from casebook.sources import kept_tables as t
from casebook.sources import tables
from casebook.sources.tables import DOC_FEATURES


@query(
    "stratified_holdout",
    f"WITH {OM}, k AS (SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY case_id) AS row_no, "
    "count(*) OVER (PARTITION BY label) AS n FROM om) "
    "SELECT case_id, label, CASE WHEN row_no <= round_even(n * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS side FROM k",
)
def stratified_holdout(spark, sf):
    df, spec = tables.orders_matrix(spark, sf)
    return splitting.stratified_holdout(df.select(*spec.keys), spec, 0.3, seed=None)


@query(
    "random_holdout_counts",
    f"WITH {OM}, c AS (SELECT label, count(*) AS n FROM om GROUP BY 1) "
    "SELECT label, 'test' AS side, round_even(n * 0.3::DOUBLE, 0)::BIGINT AS n FROM c UNION ALL "
    "SELECT label, 'train', n - round_even(n * 0.3::DOUBLE, 0)::BIGINT FROM c",
)
def random_holdout_counts(spark, sf):
    df, spec = tables.orders_matrix(spark, sf)
    s = splitting.stratified_holdout(df.select(*spec.keys), spec, 0.3, seed=7)
    return s.groupBy("label", "side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "survival_holdout",
    f"WITH {OS}, k AS (SELECT case_id, event, row_number() OVER (PARTITION BY event ORDER BY case_id) AS row_no, "
    "count(*) OVER (PARTITION BY event) AS n FROM os) "
    "SELECT case_id, event, CASE WHEN row_no <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS side FROM k",
)
def survival_holdout(spark, sf):
    df, spec = tables.orders_survival(spark, sf)
    return splitting.stratified_holdout(df.select("case_id", "event"), spec, 0.2, seed=None)


_SEEDS = 100


@query(
    "candidate_holdouts",
    f"WITH {OM}, c AS (SELECT count(*) AS n, round_even(count(*) * 0.3::DOUBLE, 0)::BIGINT AS t FROM om GROUP BY label) "
    f"SELECT seed::INT AS seed, 'test' AS side, sum(t)::BIGINT AS n FROM c, range({_SEEDS}) s(seed) GROUP BY 1 "
    f"UNION ALL SELECT seed::INT, 'train', sum(n - t)::BIGINT FROM c, range({_SEEDS}) s(seed) GROUP BY 1",
)
def candidate_holdouts(spark, sf):
    """Sizes of several candidate holdouts drawn in one job."""
    df, spec = tables.orders_matrix(spark, sf)
    sides = splitting.seeded_sides(df, spec, 0.3, list(range(_SEEDS)))
    return sides.groupBy("seed", "side").agg(F.count(F.lit(1)).alias("n"))


_FOLD = 5


@query(
    "stratified_folds",
    f"""WITH {OM},
c AS (SELECT label, count(*) AS n, min(case_id) AS first_id FROM om GROUP BY 1),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c),
a AS (SELECT label, f, count(*) AS size FROM (SELECT label, unnest(range(start, start + n)) % {_FOLD} AS f FROM s) GROUP BY 1, 2),
e AS (SELECT label, f, sum(size) OVER (PARTITION BY label ORDER BY f) AS last_no FROM a),
k AS (SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY case_id) AS row_no FROM om)
SELECT k.case_id, k.label, min(e.f)::INT AS fold FROM k JOIN e ON k.label = e.label AND k.row_no <= e.last_no GROUP BY 1, 2""",
)
def stratified_folds(spark, sf):
    df, spec = tables.orders_matrix(spark, sf)
    return splitting.stratified_folds(df.select(*spec.keys), spec, _FOLD)


@query(
    "leave_one_out",
    f"WITH {DM} SELECT case_id, (row_number() OVER (ORDER BY case_id) - 1)::INT AS fold FROM dm",
)
def leave_one_out(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return splitting.leave_one_out(df.select("case_id"), spec)


@query(
    "survival_folds",
    f"WITH {OS}, k AS (SELECT case_id, event, row_number() OVER (ORDER BY event, case_id) AS pos FROM os) "
    "SELECT case_id, event, ((pos - 1) % 5 + 1)::INT AS fold FROM k",
)
def survival_folds(spark, sf):
    df, spec = tables.orders_survival(spark, sf)
    return splitting.survival_folds(df.select("case_id", "event"), spec, 5, seed=None)


@query(
    "survival_folds_random",
    f"WITH {OS}, c AS (SELECT count(*) FILTER (WHERE event = 0) AS a, count(*) AS n FROM os) "
    "SELECT (i % 5 + 1)::INT AS fold, (i >= a)::INT AS event, count(*) AS n FROM (SELECT a, unnest(range(n)) AS i FROM c) GROUP BY 1, 2",
)
def survival_folds_random(spark, sf):
    df, spec = tables.orders_survival(spark, sf)
    f = splitting.survival_folds(df.select("case_id", "event"), spec, 5, seed=0)
    return f.groupBy("fold", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "up_sampling_counts",
    f"WITH {DM}, c AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM dm GROUP BY label)) "
    "SELECT label, c.n FROM (SELECT DISTINCT label FROM dm), c",
)
def up_sampling_counts(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return balance.up_sample(spec.project(df), spec).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "down_sampling_counts",
    f"WITH {OM}, c AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM om GROUP BY label)) "
    "SELECT label, c.n FROM (SELECT DISTINCT label FROM om), c",
)
def down_sampling_counts(spark, sf):
    df, spec = tables.orders_matrix(spark, sf)
    return balance.down_sample(df, spec).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "smote_counts",
    f"WITH {DM}, c AS (SELECT label, count(*) AS n FROM dm GROUP BY 1) "
    "SELECT label, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS synthetic FROM c",
)
def smote_counts(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return balance.smote(df, spec).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count("neighbor_id").alias("synthetic")
    )


@query(
    "smote_on_segments",
    f"WITH {DM}, c AS (SELECT count(*) AS n FROM dm GROUP BY label) "
    "SELECT max(n) - min(n) AS made, max(n) - min(n) AS on_segment FROM c",
)
def smote_on_segments(spark, sf):
    """Every made case lies between the two cases of the rare label that it names."""
    df, spec = t.docs_matrix(spark, sf)
    made = balance.smote(df, spec).filter("neighbor_id IS NOT NULL")
    ends = df.select("case_id", F.array(*[F.col(f).cast("double") for f in spec.features]).alias("at"), F.col("label").alias("own"))
    both = made.withColumn("x", F.array(*[F.col(f).cast("double") for f in spec.features])).select("x", "source_id", "neighbor_id", "label")
    for end in ("source", "neighbor"):
        both = both.join(ends.select(F.col("case_id").alias(f"{end}_id"), F.col("at").alias(end), F.col("own").alias(f"{end}_own")), f"{end}_id")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    step = F.zip_with("neighbor", "source", lambda a, b: a - b)
    moved = F.zip_with("x", "source", lambda a, b: a - b)
    share = F.coalesce(over(dot(moved, step), dot(step, step)), F.lit(0.0))
    placed = both.withColumn("step", step).withColumn("moved", moved).withColumn("share", share)
    off = F.zip_with("moved", "step", lambda m, s: m - s * F.col("share"))
    scale = 1 + dot(F.col("source"), F.col("source"))
    fine = (dot(off, off) <= 1e-12 * scale) & F.col("share").between(-1e-9, 1 + 1e-9)
    fine = fine & (F.col("source_own") == F.col("label")) & (F.col("neighbor_own") == F.col("label"))
    return placed.agg(F.count(F.lit(1)).alias("made"), F.count_if(fine).alias("on_segment"))


@query("smote_rows")
def smote_rows(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return balance.smote(df, spec)


def _dist2(a, b, feats):
    return " + ".join(f"({a}.{f} - {b}.{f}) ** 2" for f in feats)


@query(
    "tomek_links",
    f"""WITH {DM},
d AS (SELECT a.case_id, a.label, b.case_id AS neighbor_id, b.label AS neighbor_label,
 row_number() OVER (PARTITION BY a.case_id ORDER BY {_dist2('a', 'b', DOC_FEATURES)}, b.case_id) AS k
 FROM dm a JOIN dm b ON a.case_id <> b.case_id),
o AS (SELECT * FROM d WHERE k = 1)
SELECT x.case_id, x.neighbor_id FROM o x JOIN o y ON x.neighbor_id = y.case_id AND y.neighbor_id = x.case_id
WHERE x.label <> x.neighbor_label""",
)
def tomek_links(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return balance.tomek_links(df, spec)


@query("smote_tomek")
def smote_tomek(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return balance.smote_tomek(df, spec).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("no_balancing", f"WITH {OM} SELECT * FROM om")
def no_balancing(spark, sf):
    return balance.unbalanced(*t.orders_matrix(spark, sf))


@query("bootstrap_weights")
def bootstrap_weights(spark, sf):
    """Mean and variance of the replicate weights: both are close to one."""
    df, spec = t.orders_matrix(spark, sf)
    w, names = balance.bootstrap_weights(df.select("case_id"), "case_id", 100)
    long = w.unpivot(["case_id"], names, "replicate", "w")
    return long.groupBy("replicate").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("variance"))


@query(
    "balanced_holdout",
    f"WITH {DM}, c AS (SELECT label, count(*) AS n, round_even(count(*) * 0.3::DOUBLE, 0)::BIGINT AS t FROM dm GROUP BY 1) "
    "SELECT label, 'test' AS side, t AS n FROM c UNION ALL SELECT label, 'train', n - t FROM c",
)
def balanced_holdout(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    clinical = t.docs_clinical(spark, sf)
    out = searches.balanced_holdout(df, spec, clinical)
    return out.groupBy("label", "side").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_holdout")
def cluster_holdout(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    out, info = searches.cluster_holdout(df, spec, t.docs_clinical(spark, sf).select("case_id", "toxic"), parts=4)
    return info
