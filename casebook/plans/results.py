"""Queries on the long table of exploration results.

Rows: normalizer, reducer, selector, n_features, classifier, split, and metric columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import col

DIMENSIONS = ("normalizer", "reducer", "selector", "n_features", "classifier")


def choices(spark, options: dict[str, list]) -> DataFrame:
    """Every combination of the given option lists, one column per option."""
    out = spark.range(1)
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def choices_from(df: DataFrame, dims: list[str]) -> DataFrame:
    """Every combination of the values that occur in each dimension column (option-sized sets)."""
    sets = df.agg(*[F.array_sort(F.collect_set(d)).alias(d) for d in dims])
    for d in dims:
        sets = sets.withColumn(d, F.explode(d))
    return sets


def with_name(df: DataFrame, dims=DIMENSIONS, out="name") -> DataFrame:
    return df.withColumn(out, F.concat_ws("_", *[col(d).cast("string") for d in dims]))


def from_name(df: DataFrame, dims=DIMENSIONS, name="name") -> DataFrame:
    parts = F.split(col(name), "_")
    cols = {d: parts[i].cast("int") if d == "n_features" else parts[i] for i, d in enumerate(dims)}
    return df.withColumns(cols)


def without_level(df: DataFrame, drop="n_features", dims=DIMENSIONS, out="short_name") -> DataFrame:
    """The name without one level, next to the full one."""
    return with_name(df, [d for d in dims if d != drop], out)


def slice_axis(df: DataFrame, fixed: dict, axis: str, values=("auc", "std")) -> DataFrame:
    """Fix all coordinates but one and list the metric along it."""
    for k, v in fixed.items():
        df = df.filter(col(k) == F.lit(v))
    return df.select(axis, *values).orderBy(axis)


def splits_side_by_side(df: DataFrame, dims: list[str], splits: list[str], metric="auc") -> DataFrame:
    return df.groupBy(*dims).pivot("split", splits).agg(F.first(metric))


def best_number(df: DataFrame, by: list[str], number="n_features", metric="auc") -> DataFrame:
    """Feature number with the highest metric; the smaller number on ties."""
    best = F.max_by(F.struct(number, metric), F.struct(col(metric), -col(number)))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{number}", f"b.{metric}")


def one_standard_error(df: DataFrame, by: list[str], number="n_features", metric="auc", std="std") -> DataFrame:
    """Smallest feature number whose metric is within one deviation of the best one."""
    top = df.groupBy(*by).agg(
        F.max(metric).alias("_max"), F.max_by(std, F.struct(col(metric), -col(number))).alias("_sd")
    )
    ok = df.join(top, by).filter(col(metric) >= F.col("_max") - F.col("_sd"))
    pick = ok.groupBy(*by).agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), number).alias("b"))
    return pick.select(*by, "b.*")


def near_the_best(df: DataFrame, metric="auc", low="ci_low", high="ci_high", tie: list[str] = ()) -> DataFrame:
    """Models whose metric lies inside the interval of the best model."""
    best = df.agg(
        F.max_by(F.struct(col(low).alias("lo"), col(high).alias("hi")), F.struct(metric, *tie)).alias("b")
    ).head()
    if best.b is None:
        return df.limit(0)
    return df.filter(col(metric).between(best.b.lo, best.b.hi))


def interval_from_text(df: DataFrame, text: str, low="ci_low", high="ci_high") -> DataFrame:
    """Numbers out of an interval text such as ``[0.7000-0.9000]``."""
    num = F.regexp_extract_all(col(text), F.lit(r"(\d+\.?\d*)"), 1)
    return df.withColumn(low, num[0].cast("double")).withColumn(high, num[1].cast("double"))


def sorted_by(df: DataFrame, *keys, ascending=True) -> DataFrame:
    return df.orderBy(*keys, ascending=ascending)

