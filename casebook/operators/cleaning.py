"""Choosing columns and cases: projections, validity, near-constant features, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.functions.exprs import col, is_invalid, literal_rows
from casebook.operators.prefix import numbered
from casebook.spec import MatrixSpec

NEAR_CONSTANT_SHARE = 0.9
MIN_CLASS_CASES = 10


def select_by_index(df: DataFrame, spec: MatrixSpec, indexes, keep_order=False):
    """Features by position. Classification sorts the positions first, survival keeps the given order."""
    order = list(indexes) if keep_order else sorted(indexes)
    picked = spec.only(spec.features[i] for i in order)
    return picked.project(df), picked


def select_by_name(df: DataFrame, spec: MatrixSpec, names):
    missing = [n for n in names if n not in spec.features]
    if missing:
        raise ValueError(f"features not in the matrix: {missing}")
    picked = spec.only(names)
    return picked.project(df), picked


def select_by_part(df: DataFrame, spec: MatrixSpec, parts):
    """Features whose name holds any of the given parts, in name order."""
    picked = spec.only(sorted({f for f in spec.features for p in parts if p in f}))
    return picked.project(df), picked


def drop_text_columns(df: DataFrame, spec: MatrixSpec):
    numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    picked = spec.only(f for f in spec.features if f in numeric)
    return picked.project(df), picked


def near_constant(df: DataFrame, spec: MatrixSpec, share=NEAR_CONSTANT_SHARE) -> list[str]:
    """Features whose commonest value holds at least ``share`` (> 0.5) of the cases.

    Missing counts as a value. Any other such value fills the middle of the sorted
    column, so even a rough median finds it. Two passes with one number per feature replace a count of every
    distinct (feature, value).
    """
    if share <= 0.5:
        raise ValueError("share must be above one half")
    accuracy = max(100, int(10 / (share - 0.5)))
    mid = df.agg(*[F.percentile_approx(col(f).cast("double"), 0.5, accuracy).alias(f) for f in spec.features]).head()
    hits = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(col(f).cast("double").eqNullSafe(F.lit(mid[f]).cast("double"))).alias(f) for f in spec.features],
        *[F.count_if(col(f).isNull()).alias(f"_null_{f}") for f in spec.features],
    ).head()
    return [f for f in spec.features if hits["_n"] and max(hits[f], hits[f"_null_{f}"]) / hits["_n"] >= share]


def drop_near_constant(df: DataFrame, spec: MatrixSpec, share=NEAR_CONSTANT_SHARE):
    gone = set(near_constant(df, spec, share))
    picked = spec.only(f for f in spec.features if f not in gone)
    return picked.project(df), picked


def mode_share(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """The exact share of the commonest value of every feature: feature, mode_share."""
    counts = spec.long(df).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("mode_share"))


def invalid_counts(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Number of invalid cells per feature, counted in one pass."""
    one = df.agg(*[F.count_if(is_invalid(f)).alias(f) for f in spec.features])
    return one.unpivot([], list(spec.features), "feature", "n_invalid")


def first_invalid_cell(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """The first bad cell in case order, then feature order: case_id, feature (no row when all are valid)."""
    first_bad = F.coalesce(*[F.when(is_invalid(f), F.lit(f)) for f in spec.features])
    return (
        df.select(spec.case_id, first_bad.alias("feature"))
        .filter(F.col("feature").isNotNull())
        .agg(F.min(F.struct(spec.case_id, "feature")).alias("m"))
        .filter(F.col("m").isNotNull())
        .select(f"m.{spec.case_id}", "m.feature")
    )


def first_invalid_label(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    bad = ~F.coalesce(col(spec.label).try_cast("double").isin(0.0, 1.0), F.lit(False))
    return df.filter(bad).agg(F.min(spec.case_id).alias(spec.case_id)).filter(F.col(spec.case_id).isNotNull())


def drop_invalid_cases(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    ok = F.lit(True)
    for f in spec.features:
        ok = ok & ~is_invalid(f)
    return df.filter(ok)


def drop_invalid_features(df: DataFrame, spec: MatrixSpec):
    counts = df.agg(*[F.count_if(is_invalid(f)).alias(f) for f in spec.features]).head()
    picked = spec.only(f for f in spec.features if counts[f] == 0)
    return picked.project(df), picked


def invalid_block(df: DataFrame, spec: MatrixSpec):
    """The export of what is wrong: cases with a bad cell x features with a bad cell."""
    counts = df.agg(*[F.count_if(is_invalid(f)).alias(f) for f in spec.features]).head()
    feats = [f for f in spec.features if counts[f] > 0]
    bad = F.lit(False)
    for f in feats:
        bad = bad | is_invalid(f)
    return df.filter(bad).select(spec.case_id, *feats), spec.only(feats)


def typed(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Cast a text matrix whose cells are known to be valid."""
    return df.select(
        spec.case_id, col(spec.label).cast("int").alias(spec.label), *[col(f).cast("double").alias(f) for f in spec.features]
    )


def label_counts(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    return df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("n"))


def check_binary(df: DataFrame, spec: MatrixSpec, min_cases=MIN_CLASS_CASES) -> DataFrame:
    """One row: are there exactly the labels 0 and 1, and enough cases of each?"""
    y = col(spec.label)
    pos, neg = F.count_if(y == 1), F.count_if(y == 0)
    other = F.count(F.lit(1)) - pos - neg
    return df.agg(
        ((other == 0) & (pos > 0) & (neg > 0)).alias("is_binary"),
        (F.least(pos, neg) >= min_cases).alias("has_enough_cases"),
    )


def summary(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    y = col(spec.label)
    return df.agg(
        F.count(F.lit(1)).alias("cases"),
        F.lit(len(spec.features)).cast("bigint").alias("features"),
        F.count_if(y == 1).alias("positives"),
        F.count_if(y == 0).alias("negatives"),
    )


def one_hot(df: DataFrame, columns, keep_original=False) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` for each value of each named column.

    Every value becomes a column, so this suits as many values as a table can have columns;
    ``one_hot_long`` holds any number of them.
    """
    out = df
    for c in columns:
        values = sorted(str(r[0]) for r in df.select(col(c)).distinct().filter(col(c).isNotNull()).collect())
        hot = {f"{c}_{v}": F.coalesce((col(c).cast("string") == v), F.lit(False)).cast("int") for v in values}
        out = out.withColumns(hot)
    return out if keep_original else out.drop(*columns)


def one_hot_long(df: DataFrame, case_id: str, columns) -> DataFrame:
    """The cells of the same table that are 1: case_id, and ``feature`` as ``<column>_<value>``."""
    long = df.unpivot([col(case_id)], [col(c).cast("string").alias(c) for c in columns], "_column", "_value")
    named = F.concat_ws("_", "_column", "_value").alias("feature")
    return long.filter("_value IS NOT NULL").select(case_id, named)


def prefixed(df: DataFrame, spec: MatrixSpec, prefix: str):
    names = {f: f"{prefix}_{f}" for f in spec.features}
    return df.withColumnsRenamed(names), spec.only(names.values())


def cut_groups(df: DataFrame, reference: str, cuts, case_id="case_id", disjoint=False) -> DataFrame:
    """Groups of cases by cut points: below each cut (overlapping) and at or above the last one.

    ``disjoint`` assigns each case to its first group only.
    """
    x = col(reference)
    tests = [(f"{reference} < {c:g}", x < c) for c in cuts] + [(f"{reference} >= {cuts[-1]:g}", x >= cuts[-1])]
    names = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda g: g.isNotNull())
    if disjoint:
        names = F.slice(names, 1, 1)
    return df.select(F.explode(names).alias("cut_group"), case_id)


def ordered(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Cases by id as text, features by name."""
    return df.select(*spec.keys, *sorted(spec.features)).orderBy(spec.case_id)


def feature_name_parts(names: DataFrame, column="feature", position="position") -> DataFrame:
    """Split ``sequence_image_class_feature`` names into a short name and a group.

    A level with one value over all names is blanked in the group text; groups are
    numbered by first appearance. The input has one row per feature.
    """
    sep = F.split(col(column), "_")
    sep = F.when(F.size(sep) == 2, F.array(sep[0], F.lit(""), F.lit(""), sep[1])).otherwise(sep)
    last = F.element_at("sep", -1)
    caps = F.regexp_extract_all(last, F.lit("([A-Z])"), 1)
    short = F.when((F.length(last) <= 5), last).when(F.size(caps) <= 1, F.substring(last, 1, 5)).otherwise(
        F.array_join(caps, "")
    )
    p = names.withColumn("sep", sep).select(
        col(position).alias("position"),
        col(column).alias("feature"),
        short.alias("short_name"),
        F.element_at("sep", 1).alias("seq"),
        F.element_at("sep", 2).alias("image"),
        F.element_at("sep", -2).alias("class"),
    )
    levels = ("seq", "image", "class")
    ends = p.agg(*[(F.min(c) == F.max(c)).alias(c) for c in levels]).head()
    p = p.withColumn("group_name", F.concat_ws("-", *[F.lit("") if ends[c] else F.col(c) for c in levels]))
    first = p.groupBy("group_name").agg(F.min("position").alias("_first"))
    order = numbered(first, [], "_first", out="_no")
    return p.join(order, "group_name").select(
        "position", "feature", "short_name", "group_name", (F.col("_no") - 1).cast("int").alias("group_index")
    )


def state_rows(spark, rows: list[dict]) -> DataFrame:
    """A short list of option or state rows as a DataFrame."""
    return spark.range(1).select(F.inline(literal_rows(rows)))
