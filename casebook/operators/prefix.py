"""Global order without one-task windows.

A window over a whole class, feature or score list would put all of its rows on
one task. The helpers here cut the order key into range buckets, run the window
inside (group, bucket) and add per-bucket offsets, so no task sees more than about
1/buckets of the rows, even when one group holds most of them. Cut points are
pooled over all groups: a bucket holds at most its share of all rows, so every
(group, bucket) cell does too.

Cut points are found by one map-side sketch pass and then enter the plan as
literals, so a recomputed task always puts a row in the same bucket.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.functions.exprs import col

SAMPLE_A_BUCKET = 100
#: Rows of a bucket that is ordered row by row, if the session's number of shuffle partitions would leave it more.
ROWS_A_BUCKET = 100_000


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions: the cluster's own measure of a task's share."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sampled(df: DataFrame, keys: list[str], buckets: int, rows: int | None = None) -> DataFrame:
    """About ``SAMPLE_A_BUCKET`` rows a bucket. Cut points need no more: they only balance the buckets."""
    own = df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    want, rows = SAMPLE_A_BUCKET * buckets, own.count() if rows is None else rows
    return own if rows <= want else own.sample(want / rows, seed=17)


def range_splits(df: DataFrame, key: str, buckets: int, isolate=False, rows: int | None = None) -> list[float]:
    """Inner cut points of ``key``; a bounded list of at most 2 * buckets numbers.

    With ``isolate`` a value that fills more than one quantile gets a bucket of its own.
    """
    if buckets <= 1:
        return []
    return splits_of(df, [key], buckets, isolate, rows)[key]


def splits_of(df: DataFrame, keys: list[str], buckets: int, isolate=False, rows: int | None = None) -> dict[str, list[float]]:
    """Cut points of several keys from one pass."""
    if buckets <= 1:
        return {k: [] for k in keys}
    sample = _sampled(df, keys, buckets, rows)
    sample = sample.select(*[col(c).cast("double").alias(c) for c in sample.columns]).toPandas()
    out = {}
    for i, k in enumerate(keys):
        seen = np.sort(sample[f"k{i}"].dropna().to_numpy(np.float64))
        q = [float(seen[len(seen) * j // buckets]) for j in range(1, buckets)] if len(seen) else []
        q = [v for v in q if math.isfinite(v)]
        cuts = set(q)
        if isolate:
            cuts |= {float(np.nextafter(v, np.inf)) for v, n in Counter(q).items() if n > 1}
        out[k] = sorted(cuts)
    return out


def text_splits(df: DataFrame, key: str, buckets: int, rows: int | None = None) -> list[str]:
    """Cut points of a unique text key from a bounded sample."""
    if buckets <= 1:
        return []
    ids = sorted(r.k0 for r in _sampled(df, [key], buckets, rows).collect() if r.k0 is not None)
    return sorted({ids[len(ids) * i // buckets] for i in range(1, buckets)}) if ids else []


def with_bucket(df: DataFrame, key: str, splits: list, out="_bucket") -> DataFrame:
    """Bucket number of ``key``: how many cut points are at or below it."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    if isinstance(splits[0], str):
        cuts = np.array(splits, dtype=object)

        @F.pandas_udf(T.IntegerType())
        def locate(s: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, s.to_numpy(dtype=object), side="right"), dtype="int32")

        return df.withColumn(out, F.coalesce(locate(col(key)), F.lit(0)))
    b = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol="_key", outputCol=out, handleInvalid="keep"
    )
    # Declared not null: otherwise a null filter is pushed below one of the two readers of the
    # bucketed table, and they no longer share its shuffle.
    return b.transform(df.withColumn("_key", col(key).cast("double"))).drop("_key").withColumn(
        out, F.coalesce(F.col(out).cast("int"), F.lit(0))
    )


def _offsets(bucketed: DataFrame, group: list[str], sums: dict, bucket: str) -> DataFrame:
    """Totals before each bucket and over the whole group; at most ``buckets`` rows per group."""
    per = bucketed.groupBy(*group, bucket).agg(*[e.alias(f"_s_{n}") for n, e in sums.items()])
    anchor = group or [F.lit(0)]
    w = Window.partitionBy(*anchor).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*anchor)
    return per.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(all_).alias(f"total_{n}") for n in sums],
    )


def join_groups(local: DataFrame, off: DataFrame, keys: list[str]) -> DataFrame:
    """Join a table with one row a group; a null key is a key like any other."""
    named = off.select(*[col(k).alias(f"_k_{k}") for k in keys], *[c for c in off.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_k_{k}")) for k in keys])
    return local.join(named, same).drop(*[f"_k_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    group: list[str],
    key: str,
    sums: list[str],
    *,
    splits: list | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """Add ``before_<c>`` (total over strictly smaller keys) and ``total_<c>`` per group.

    ``df`` must hold one row per (group, key). Pass ``bucket`` to reuse a bucket
    column made with ``with_bucket``; it is kept in the result.
    """
    keep = bucket is not None
    if not keep:
        bucket = "_bucket"
        cuts = range_splits(df, key, bucket_count(df)) if splits is None else splits
        df = with_bucket(df, key, cuts, bucket)
    off = _offsets(df, group, {c: F.sum(c) for c in sums}, bucket)
    inner = Window.partitionBy(*group, bucket).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_l_{c}") for c in sums])
    out = join_groups(local, off, [*group, bucket]).select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )
    return out if keep else out.drop(bucket)


def numbered(df: DataFrame, group: list[str], key: str, out="row_no", ties: list[str] = ()) -> DataFrame:
    """1-based position within ``group`` by ``key`` (unique, or made unique by ``ties``), plus ``group_n``.

    Integer keys are expected to be hashes (see ``hashed``) or ids; text keys are
    range-cut from a bounded sample. There is a bucket and a task for at most about ``ROWS_A_BUCKET`` rows.
    """
    rows = df.count()
    n = max(bucket_count(df), -(-rows // ROWS_A_BUCKET))
    cuts = text_splits(df, key, n, rows) if dict(df.dtypes)[key] == "string" else range_splits(df, key, n, rows=rows)
    b = with_bucket(df, key, cuts)
    # Offsets do not wait for the rows to move: they are known in time for a join that does not move the rows again.
    off = _offsets(b, group, {"n": F.count(F.lit(1))}, "_bucket")
    if n > bucket_count(df):
        b = b.repartition(n, *[col(g) for g in group], "_bucket")
    w = Window.partitionBy(*group, "_bucket").orderBy(key, *ties)
    ranked = join_groups(b.withColumn("_r", F.row_number().over(w)), off, [*group, "_bucket"])
    return ranked.select(*df.columns, (F.col("_r") + F.col("_o_n")).alias(out), F.col("total_n").alias("group_n"))


def shuffled_order(df: DataFrame, group: list[str], order_hash: str, tie: str, out="row_no") -> DataFrame:
    """Position within ``group`` in hash order. Hashes are uniform, so equal-width cuts of the
    64-bit range are balanced and no sketch pass is needed."""
    bits = max(0, math.ceil(math.log2(bucket_count(df))))
    # The arithmetic shift keeps the sign, so bucket order is hash order.
    b = df.withColumn("_bucket", F.shiftright(order_hash, 64 - bits) if bits else F.lit(0).cast("long"))
    off = _offsets(b, group, {"n": F.count(F.lit(1))}, "_bucket")
    w = Window.partitionBy(*group, "_bucket").orderBy(order_hash, tie)
    ranked = join_groups(b.withColumn("_r", F.row_number().over(w)), off, [*group, "_bucket"])
    return ranked.select(*df.columns, (F.col("_r") + F.col("_o_n")).alias(out), F.col("total_n").alias("group_n"))


def min_rank(df: DataFrame, group: list[str], key: str, out="rank_no", splits: list | None = None) -> DataFrame:
    """Rank with ties equal: one more than the number of rows with a smaller key.

    A value common enough to fill a bucket of its own is salted over all tasks:
    within such a bucket every row ranks first, so the salt does not change the rank.
    Given ``splits`` must come from ``range_splits`` with ``isolate``.
    """
    n = bucket_count(df)
    cuts = range_splits(df, key, n, isolate=True) if splits is None else splits
    lone = [i + 1 for i in range(len(cuts) - 1) if np.nextafter(cuts[i], np.inf) == cuts[i + 1]]
    b = with_bucket(df, key, cuts)
    salt = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(n))
    b = b.withColumn("_salt", F.when(F.col("_bucket").isin(lone), salt).otherwise(0) if lone else F.lit(0))
    off = _offsets(b, group, {"n": F.count(F.lit(1))}, "_bucket")
    w = Window.partitionBy(*group, "_bucket", "_salt").orderBy(key)
    ranked = join_groups(b.withColumn("_r", F.rank().over(w)), off, [*group, "_bucket"])
    return ranked.select(*df.columns, (F.col("_r") + F.col("_o_n")).alias(out))
