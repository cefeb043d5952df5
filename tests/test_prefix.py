import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.functions.exprs import hashed
from casebook.operators import prefix


def skewed(spark, n=3000, seed=3):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.35, 7.0, rng.normal(5, 4, n).round(2))
    return spark.createDataFrame(pd.DataFrame({"g": np.where(rng.random(n) < 0.9, "big", "small"), "v": v, "w": 1 + rng.integers(0, 3, n)}))


def test_running_totals_equal_a_plain_window(spark):
    d = skewed(spark).groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = prefix.running_totals(d, ["g"], "v", ["w"]).toPandas().sort_values(["g", "v"], ignore_index=True)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = d.withColumn("before_w", F.coalesce(F.sum("w").over(w), F.lit(0))).withColumn(
        "total_w", F.sum("w").over(Window.partitionBy("g"))
    )
    want = want.toPandas().sort_values(["g", "v"], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_numbering_gives_a_task_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_A_BUCKET", 50, raising=False)
    ordered, join = [], prefix.join_groups
    monkeypatch.setattr(prefix, "join_groups", lambda local, *rest: ordered.append(local) or join(local, *rest))
    d = skewed(spark).withColumn("at", F.monotonically_increasing_id()).withColumn("id", F.col("at").cast("string"))
    w = Window.partitionBy("g")
    for key in ("id", "at"):
        got = prefix.numbered(d, ["g"], key)
        want = d.withColumn("row_no", F.row_number().over(w.orderBy(key)).cast("long")).withColumn("group_n", F.count("*").over(w))
        columns = ["g", "id", "row_no", "group_n"]
        assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
        sizes = [r["count"] for r in ordered[-1].filter("_r > 0").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > prefix.bucket_count(d) and max(sizes) <= 8 * 50


@pytest.mark.parametrize("parts", [1, 16])
def test_min_rank_with_a_common_value(spark, parts):
    d = skewed(spark).repartition(parts)
    got = prefix.min_rank(d, ["g"], "v").groupBy("g", "v").agg(F.min("rank_no").alias("r"), F.max("rank_no").alias("s"))
    want = d.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("v"))).select("g", "v", "r").distinct()
    g, w = got.toPandas(), want.toPandas()
    assert (g.r == g.s).all()
    m = g.merge(w, on=["g", "v"])
    assert len(m) == len(w) and (m.r_x == m.r_y).all()


def test_isolated_value_has_its_own_bucket(spark):
    cuts = prefix.range_splits(skewed(spark), "v", 8, isolate=True)
    assert 7.0 in cuts and float(np.nextafter(7.0, np.inf)) in cuts


def test_numbering_by_text_and_by_hash(spark):
    d = spark.range(997).select((F.col("id") % 3).alias("g"), F.format_string("id%04d", "id").alias("k"))
    got = prefix.numbered(d, ["g"], "k").toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("k")
        assert part.row_no.tolist() == list(range(1, len(part) + 1))
        assert (part.group_n == len(part)).all()
    h = prefix.shuffled_order(d.withColumn("h", hashed(1, "k")), ["g"], "h", "k").toPandas()
    for _, part in h.groupby("g"):
        part = part.sort_values("h")
        assert part.row_no.tolist() == list(range(1, len(part) + 1))


def test_rows_of_a_null_group_are_kept(spark):
    rows = [("a" if i % 3 else None, i % 7, f"k{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v int, k string")
    counts = df.groupBy("g", "v").count()
    totals = prefix.running_totals(counts, ["g"], "v", ["count"]).collect()
    assert len(totals) == counts.count()
    for r in totals:
        assert r.before_count == sum(1 for g, v, _ in rows if g == r.g and v < r.v)
    for out in (prefix.numbered(df, ["g"], "k"), prefix.min_rank(df, ["g"], "v", out="row_no")):
        assert out.count() == 40 and out.filter("row_no IS NULL").count() == 0
    numbers = {r.k: r.row_no for r in prefix.numbered(df, ["g"], "k").collect()}
    for g in ("a", None):
        own = sorted(k for h, _, k in rows if h == g)
        assert [numbers[k] for k in own] == list(range(1, len(own) + 1))
