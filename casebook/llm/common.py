"""What the operators share: whole texts in bounded slices, shared folders, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, with its file system's scheme."""
    folder = ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for a third of the ids, by crc32 of the id's text; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key() -> Column:
    """A row's id and the hash of its whole text, white space included; null counts as empty."""
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(whole_text(), 256)).alias("sha"))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``grouped`` (key, kept) drops; of the rows of a kept key one stays.

    ``grouped`` has a row for each row of ``docs`` that is not alone in its group.
    """
    keys = grouped.groupBy("key").agg(F.count("*").alias("n"), F.first("kept").alias("kept")).filter("NOT kept OR n > 1")
    keys = written(keys.select("key", "kept"), "decided")
    own = docs.withColumn("__own", row_key())
    left = own.join(keys, F.col("__own").eqNullSafe(F.col("key")), "left_anti")
    repeated = keys.filter("kept")
    if not repeated.isEmpty():
        again = own.join(repeated, F.col("__own").eqNullSafe(F.col("key")), "left_semi")
        left = left.union(again.dropDuplicates(["__own"]))
    return left.drop("__own")


def in_slices(batches: Iterable[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with the texts of their column ``text``, in runs of about ``chars`` characters; a longer text is a run alone."""
    for batch in batches:
        start, size, run = 0, 0, []
        for text in batch.column("text"):
            text = text.as_py()
            if run and size + len(text) > chars:
                yield batch.slice(start, len(run)), run
                start, size, run = start + len(run), 0, []
            run.append(text)
            size += len(text)
        if run:
            yield batch.slice(start, len(run)), run


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Columns (sequences, numpy or Arrow arrays) as a batch of ``schema``."""
    arrays = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
