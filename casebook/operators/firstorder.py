"""First-order statistics of measurements per (case, series).

Input: ``case_id, series, value``. A group can be arbitrarily large, so every
statistic is a mergeable aggregate; second passes join the group's centre back,
with the rows of a group dealt over several keys.
Quantiles are exact and come from per-value counts that are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import over, rounded
from casebook.operators.prefix import bucket_count, join_groups, range_splits, running_totals
from casebook.session import kept

GROUP = ["case_id", "series"]
QUANTILES = {
    "percentile10": 0.10,
    "percentile25": 0.25,
    "median": 0.50,
    "percentile75": 0.75,
    "percentile90": 0.90,
}


SALTS = 32  # join keys that a group's rows are dealt over


def attached(rows: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of a one-row-a-group table. A group's rows are dealt over ``SALTS`` keys by the
    task that reads them, so that the join and what is summed after it share the work of a large group."""
    copies = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return join_groups(dealt, copies, [*by, "_salt"]).drop("_salt")


def group_quantiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Works on distinct values with running counts: the value at zero-based rank k
    is the one with ``before <= k < before + n``. No group is sorted on one task.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    splits = range_splits(df, value, bucket_count(df))
    cum = running_totals(counts, group, value, ["n"], splits=splits)
    aggs = []
    for name, q in quantiles.items():
        h = (F.col("total_n") - 1) * q
        for suffix, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{suffix}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_{name}_f"))
    out = cum.groupBy(*group).agg(*aggs)
    return out.select(
        *group,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
            for n in quantiles
        ],
    )


def first_order(df: DataFrame) -> DataFrame:
    """All first-order statistics per (case, series)."""
    v = F.col("value")
    base = df.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(v * v).alias("energy"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        (F.max(v) - F.min(v)).alias("value_range"),
        F.avg(v).alias("mean"),
        F.sqrt(F.avg(v * v)).alias("root_mean_square"),
        F.var_pop(v).alias("variance"),
        F.skewness(v).alias("skewness"),
        (F.kurtosis(v) + 3).alias("kurtosis"),
    )
    base = base.withColumns(
        {
            "skewness": F.when(F.col("variance") > 0, F.col("skewness")).otherwise(0.0),
            "kurtosis": F.when(F.col("variance") > 0, F.col("kurtosis")).otherwise(0.0),
        }
    )
    # one row per group, read by the second and third pass
    base = kept(join_groups(base, group_quantiles(df, GROUP, "value", QUANTILES), GROUP))
    inside = v.between(F.col("percentile10"), F.col("percentile90"))
    centred = attached(df, base.select(*GROUP, "mean", "percentile10", "percentile90"), GROUP)
    second = centred.groupBy(*GROUP).agg(
        F.avg(F.abs(v - F.col("mean"))).alias("mean_absolute_deviation"),
        F.avg(F.when(inside, v)).alias("_rmean"),
    )
    middle = join_groups(base.select(*GROUP, "percentile10", "percentile90"), second.select(*GROUP, "_rmean"), GROUP)
    third = (
        attached(df, middle, GROUP)
        .groupBy(*GROUP)
        .agg(F.avg(F.when(inside, F.abs(v - F.col("_rmean")))).alias("robust_mean_absolute_deviation"))
    )
    return (
        join_groups(join_groups(base, second.drop("_rmean"), GROUP), third, GROUP)
        .withColumn("interquartile_range", F.col("percentile75") - F.col("percentile25"))
    )


def rounded_stats(df: DataFrame, digits=8, special: dict | None = None) -> DataFrame:
    special = special or {}
    return df.select(
        *[rounded(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def histogram_features(df: DataFrame, bin_count: int | None = 16, bin_width: float | None = None) -> DataFrame:
    """Entropy (bits) and uniformity of the discretised values of each group.

    ``bin_width`` cuts at multiples of the width, otherwise the group's range is
    cut into ``bin_count`` equal bins.
    """
    ends = df.groupBy(*GROUP).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    if bin_width:
        bin_no = F.floor(v / bin_width) - F.floor(lo / bin_width)
    else:
        bin_no = F.coalesce(
            F.least(F.lit(bin_count - 1), F.floor(over(v - lo, hi - lo) * bin_count)), F.lit(0)
        )
    bins = attached(df, ends, GROUP).groupBy(*GROUP, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # sum p log p = (sum n log n) / N - log N, so one aggregate over the bins is enough
    n, total = F.col("n"), F.sum("n")
    return bins.groupBy(*GROUP).agg(
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy"),
        (F.sum(n * n.cast("double")) / (total * total.cast("double"))).alias("uniformity"),
    )


def normalized(df: DataFrame, scale=1.0, by=("case_id",)) -> DataFrame:
    """Centre and scale the values of each case; constant cases have no scale and are left out."""
    by = list(by)
    stats = df.groupBy(*by).agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    return (
        attached(df, stats, by)
        .filter(F.col("_sd") > 0)
        .withColumn("value", (F.col("value") - F.col("_mu")) / F.col("_sd") * scale)
        .drop("_mu", "_sd")
    )


def resegmented_range(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.filter(F.col("value").between(low, high))


def resegmented_sigma(df: DataFrame, k: float) -> DataFrame:
    """Keep values within ``k`` deviations of their group's mean."""
    stats = df.groupBy(*GROUP).agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    slack = 1e-9
    near = F.abs(F.col("value") - F.col("_mu")) <= k * F.col("_sd") + slack
    return attached(df, stats, GROUP).filter(near).drop("_mu", "_sd")


def large_enough(df: DataFrame, minimum: int) -> DataFrame:
    keep = df.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).drop("_n")
    return attached(df, keep, GROUP)


EXTRACTED = (
    "energy minimum maximum mean percentile10 percentile90 median interquartile_range mean_absolute_deviation "
    "root_mean_square variance skewness"
).split()


def extract(df: DataFrame, series: list[str], minimum=1, statistics=EXTRACTED) -> tuple[DataFrame, DataFrame]:
    """(features, errors): one wide row ``<series>_<statistic>`` per good case, and a reason per bad one."""
    sizes = (
        df.filter(F.col("series").isin(series))
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("s"), F.min("n").alias("least"))
    )
    verdict = F.when(F.col("s") < len(series), "missing series").when(
        F.col("least") < minimum, "too few measurements"
    )
    judged = df.select("case_id").distinct().join(sizes, "case_id", "left").select(
        "case_id", F.when(F.col("s").isNull(), "missing series").otherwise(verdict).alias("reason")
    )
    good = judged.filter(F.col("reason").isNull()).select("case_id")
    errors = judged.filter(F.col("reason").isNotNull())
    stats = first_order(df.filter(F.col("series").isin(series)).join(good, "case_id", "left_semi"))
    wide = stats.groupBy("case_id").pivot("series", series).agg(*[F.first(s).alias(s) for s in statistics])
    return wide, errors


QUALITY = "Quality_"  # fixed prefix of features that describe the measurement itself


def extraction_table(
    features: DataFrame,
    quality: DataFrame | None = None,
    labels: DataFrame | None = None,
    label="label",
    ignore: str | None = "diagnostics",
    columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(matrix, errors) of long features (case_id, feature, value), quality features (case_id, name, value) and labels
    (case_id, label).

    Quality features are named ``Quality_<name>``; features whose name holds ``ignore`` are dropped. All cases must
    have the same columns, in name order: ``columns``, or those of the first case by id. Features outside them are
    passed over; a case that lacks one is an error, as is one with two values of a feature or, given labels, with no
    label or several. Null ids are passed over. An empty table without ``columns`` gives a matrix of no features.
    """
    long = features.select("case_id", "feature", F.col("value").cast("double").alias("value"))
    if ignore:
        long = long.filter(~F.col("feature").contains(ignore))
    if quality is not None:
        named = F.concat(F.lit(QUALITY), F.col("name")).alias("feature")
        long = long.unionByName(quality.select("case_id", named, F.col("value").cast("double").alias("value")))
    long = long.filter(F.col("case_id").isNotNull() & F.col("feature").isNotNull())
    if columns is None:
        # as many names as one case has, which is what the matrix has columns
        first = long.agg(F.min("case_id").alias("c")).head().c
        columns = [r.feature for r in long.filter(F.col("case_id") == first).select("feature").distinct().collect()]
    columns = sorted(columns)
    known = F.col("feature").isin(columns)
    shape = long.groupBy("case_id", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    judged = shape.groupBy("case_id").agg(
        F.count_if(known).alias("_own"),
        F.max(F.when(known, F.col("n")).otherwise(0)).alias("_most"),
        *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in columns],
    )
    reason = F.when(F.col("_own") < len(columns), "missing features").when(F.col("_most") > 1, "repeated features")
    if labels is not None:
        marks = labels.groupBy("case_id").agg(F.count(label).alias("_labels"), F.max(label).alias(label))
        judged = judged.join(marks, "case_id", "left")
        reason = reason.when(F.coalesce("_labels", F.lit(0)) == 0, "no label").when(F.col("_labels") > 1, "several labels")
    judged = judged.withColumn("reason", reason)
    kept_columns = ["case_id", *([label] if labels is not None else []), *columns]
    good = judged.filter(F.col("reason").isNull()).select(*[F.col(f"`{c}`") for c in kept_columns])
    return good, judged.filter(F.col("reason").isNotNull()).select("case_id", "reason")
