"""Reading and writing matrices, stage state and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.exprs import col
from casebook.spec import MatrixSpec

LABEL_NAMES = ("label", "Label")
CSV_ENCODINGS = ("UTF-8", "GBK")


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line fails to decode, then GBK; stops at the first bad line."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return CSV_ENCODINGS[1] if broken.head() else CSV_ENCODINGS[0]


def read_frame(spark: SparkSession, path: str, *, schema=None, raw=False) -> DataFrame:
    """A CSV (header line) or parquet table. ``raw`` reads every CSV cell as text."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    encoding = csv_encoding(spark, path)
    if encoding != CSV_ENCODINGS[0]:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # lets the reader use charsets beyond the Unicode ones
    reader = spark.read.option("header", True).option("encoding", encoding)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", not raw).csv(path)


def case_matrix(
    df: DataFrame, id_column: str | None = None, label: str | None = None, features=None, *, emulate_label=False
) -> tuple[DataFrame, MatrixSpec]:
    """Give a raw frame the matrix shape: text case id, int label, double features in name order.

    Without ``id_column`` the first column is the id. Without a label column the
    call fails, unless ``emulate_label`` asks for a zero label.
    """
    id_column = id_column or df.columns[0]
    label = label or next((c for c in LABEL_NAMES if c in df.columns), None)
    if label is None and not emulate_label:
        raise ValueError("no label column; pass emulate_label=True to add a zero label")
    if features is None:
        features = sorted(c for c in df.columns if c not in (id_column, label))
    spec = MatrixSpec(tuple(features))
    return (
        df.select(
            col(id_column).cast("string").alias("case_id"),
            (col(label).cast("int") if label else F.lit(0)).alias("label"),
            *[col(f).cast("double").alias(f) for f in spec.features],
        ),
        spec,
    )


def survival_matrix(
    df: DataFrame, event: str, duration: str, id_column: str | None = None, features=None
) -> tuple[DataFrame, MatrixSpec]:
    """Survival shape; the event column must exist and hold exactly two values."""
    missing = [c for c in (event, duration) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    id_column = id_column or df.columns[0]
    # Two values are told apart by the extremes: no distinct set is built.
    lo_hi = df.agg(
        F.min(event).alias("lo"),
        F.max(event).alias("hi"),
    ).head()
    other = df.filter(~col(event).isin(lo_hi.lo, lo_hi.hi)).limit(1).count() if lo_hi.lo is not None else 1
    if lo_hi.lo == lo_hi.hi or other:
        raise ValueError(f"event column {event} must hold exactly two values")
    if features is None:
        features = sorted(c for c in df.columns if c not in (id_column, event, duration))
    spec = MatrixSpec(tuple(features), label="event", duration="duration")
    return (
        df.select(
            col(id_column).cast("string").alias("case_id"),
            (col(event) == F.lit(lo_hi.hi)).cast("int").alias("event"),
            col(duration).cast("double").alias("duration"),
            *[col(f).cast("double").alias(f) for f in spec.features],
        ),
        spec,
    )


def keyed_by_content(df: DataFrame, out="case_id") -> DataFrame:
    """Give a frame without a key a repeatable one: row hash plus the copy number among equal rows.

    Copies are numbered without gathering them: equal rows are counted with a
    map-side combine and the count is unfolded again.
    """
    cols = df.columns
    counted = df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    part = 100_000  # unfold in slices so that no single array holds a huge group of copies
    sliced = counted.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / part)))
    )
    numbered = sliced.withColumn(
        "_copy",
        F.explode(
            F.sequence(
                F.col("_slice") * part + 1, F.least(F.col("_n"), (F.col("_slice") + 1) * part)
            )
        ),
    )
    key = F.concat_ws("-", F.hex(F.xxhash64(*[col(c) for c in cols])), F.col("_copy").cast("string"))
    return numbered.select(key.alias(out), *[col(c) for c in cols])


def zero_labelled(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    return df.withColumn(spec.label, F.lit(0))


def save_matrix(df: DataFrame, spec: MatrixSpec, path: str, fmt="parquet", mode="overwrite") -> None:
    """Label first, features in name order, cases sorted (a range-partitioned sort)."""
    out = df.select(spec.case_id, *[c for c in spec.columns if c != spec.case_id]).orderBy(spec.case_id)
    writer = out.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def save_state(df: DataFrame, path: str) -> None:
    """Small per-stage state (one row per feature or option)."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_results(df: DataFrame, path: str, partition_by=("split",)) -> None:
    """Create or extend a long result table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


