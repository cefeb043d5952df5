"""Round trips through stored tables, and scoring a stream of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import merging, models, normalize
from casebook.queries import query
from casebook.queries.sql import DM, OM, RT, r
from casebook.session import ensure_checkpoint_dir
from casebook.sources import matrix_io
from casebook.sources import tables as t
from casebook.streaming import scoring


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("saved_matrix", f"WITH {OM} SELECT * FROM om")
def saved_matrix(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    path = _folder(spark, "matrix") + ".parquet"
    matrix_io.save_matrix(df, spec, path)
    return matrix_io.read_frame(spark, path)


@query(
    "saved_scaling_state",
    f"WITH {OM}, s AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, max({f}) - min({f}) AS slope, min({f}) AS intercept FROM om" for f in ("lines", "total")
    )
    + f") SELECT feature, {r('slope')} AS slope, {r('intercept')} AS intercept FROM s",
)
def saved_scaling_state(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    state = normalize.fit_normalizer(df, spec.only(["lines", "total"]), "MinMax")
    path = _folder(spark, "state")
    matrix_io.save_state(normalize.state_table(spark, state), path)
    out = matrix_io.load_state(spark, path)
    return out.select("feature", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@query("appended_results", f"WITH {RT} SELECT * FROM rt")
def appended_results(spark, sf):
    """Rows arrive in two appends, partitioned by selector."""
    df = t.results_table(spark, sf)
    path = _folder(spark, "results")
    matrix_io.append_results(df.filter("n_features <= 3"), path, ("selector",))
    matrix_io.append_results(df.filter("n_features > 3"), path, ("selector",))
    return spark.read.parquet(path)


@query(
    "load_mixed_types",
    f"WITH {DM} SELECT case_id, lang, source, toxic FROM dm",
)
def load_mixed_types(spark, sf):
    """A raw table with text columns next to numbers, read back as stored."""
    path = _folder(spark, "mixed") + ".parquet"
    t.docs_clinical(spark, sf).write.parquet(path)
    return matrix_io.read_frame(spark, path, raw=True)


_ONLY = {
    "orders": ("left", ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]),
    "customer": ("right", ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"]),
}


@query(
    "column_difference",
    " UNION ALL ".join(
        f"SELECT '{side}' AS side, '{c}' AS name, count({c}) AS filled FROM {table}"
        for table, (side, cols) in _ONLY.items()
        for c in cols
    ),
)
def column_difference(spark, sf):
    """Columns found on one side only, with how many of their cells are filled."""
    left, right = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    diff = merging.column_difference(left, right)
    parts = [
        table.agg(*[F.count(c).alias(c) for c in diff[side]])
        .unpivot([], diff[side], "name", "filled")
        .select(F.lit(side).alias("side"), "name", "filled")
        for side, table in (("left", left), ("right", right))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "streamed_scores",
    f"WITH {OM} SELECT case_id, label, {r('1 / (1 + exp(-(0.2::DOUBLE + 0.3::DOUBLE * lines - 0.01::DOUBLE * qty_avg)))')} AS pred, "
    "(1 / (1 + exp(-(0.2::DOUBLE + 0.3::DOUBLE * lines - 0.01::DOUBLE * qty_avg))) >= 0.7::DOUBLE)::INT AS called FROM om",
)
def streamed_scores(spark, sf):
    """The stored matrix read as a stream, scored and written by the same projection as a batch."""
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["lines", "qty_avg"])
    source, sink = _folder(spark, "arriving"), _folder(spark, "scored")
    spec.project(df).write.parquet(source)
    prepared = {
        "raw_features": list(spec.features),
        "normalizer": normalize.fit_normalizer(df, spec, "None"),
        "reducer": None,
        "features": list(spec.features),
        "model": models.LinearScore("given", ("lines", "qty_avg"), (0.3, -0.01), 0.2),
    }
    stream = scoring.score_stream(spark, source, spec.project(df).schema, spec, prepared)
    run = (
        scoring.apply_cutoff(stream, 0.7)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", f"{sink}-progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(sink).select("case_id", "label", rounded("pred").alias("pred"), "called")
