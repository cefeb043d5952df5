import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.operators import balance, searches, splitting
from tests.util import matrix


@pytest.mark.parametrize("k", [2, 3, 7])
def test_fold_sizes_differ_by_at_most_one(spark, k):
    df, spec, pdf = matrix(spark, n=101)
    f = splitting.stratified_folds(df, spec, k).toPandas()
    sizes = f.groupby("fold").size()
    assert len(sizes) == k and sizes.max() - sizes.min() <= 1
    per = f.groupby(["label", "fold"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()


def test_holdout_sizes_and_stability(spark):
    df, spec, pdf = matrix(spark, n=203)
    a = splitting.stratified_holdout(df.repartition(1), spec, 0.3, seed=4).toPandas().set_index("case_id").side
    b = splitting.stratified_holdout(df.repartition(16), spec, 0.3, seed=4).toPandas().set_index("case_id").side
    assert a.sort_index().equals(b.sort_index())
    for label, n in pdf.groupby("label").size().items():
        ids = pdf.case_id[pdf.label == label]
        assert (a[ids] == "test").sum() == round(n * 0.3)


def test_many_seeds_at_once_have_exact_sizes(spark):
    df, spec, pdf = matrix(spark, n=150)
    sides = splitting.seeded_sides(df, spec, 0.3, [0, 1, 2]).join(df.select("case_id", "label"), "case_id").toPandas()
    n = pdf.groupby("label").size()
    for (_, label), part in sides.groupby(["seed", "label"]):
        assert len(part) == n[label] and (part.side == "test").sum() == round(n[label] * 0.3)
    first = sides[(sides.seed == 0) & (sides.side == "test")].case_id
    assert set(first) != set(sides[(sides.seed == 1) & (sides.side == "test")].case_id)


def test_boundaries_of_many_seeds_need_no_counts_per_prefix(spark, monkeypatch):
    """Only cases near the expected boundary are ordered; ids that repeat a lot still give exact boundaries."""
    by_prefix = splitting._edges_by_prefix
    df, spec, _ = matrix(spark, n=3000)
    hashes = df.select("case_id", "label", F.explode(F.array(*map(F.lit, range(5)))).alias("seed")).withColumn("h", F.xxhash64("case_id", "seed"))

    def fail(*_):
        raise AssertionError("counts per prefix")

    monkeypatch.setattr(splitting, "_edges_by_prefix", fail)
    got = splitting.seeded_sides(df, spec, 0.3, list(range(5))).toPandas()
    own = hashes.toPandas().sort_values(["h", "case_id"])
    place, size = own.groupby(["seed", "label"]).cumcount(), own.groupby(["seed", "label"]).h.transform("size")
    want = own.assign(side=np.where(place < (size * 0.3).round(), "test", "train"))
    both = got.merge(want, on=["seed", "case_id"])
    assert len(both) == len(got) == 15000 and (both.side_x == both.side_y).all()

    called = []
    monkeypatch.setattr(splitting, "_edges_by_prefix", lambda *a: called.append(1) or by_prefix(*a))
    few = df.withColumn("case_id", F.substring("case_id", 1, 3))  # every id has hundreds of cases
    counts = splitting.seeded_sides(few, spec, 0.3, [0, 1]).groupBy("seed").agg(F.count_if(F.col("side") == "test").alias("n")).collect()
    assert called and len(counts) == 2 and all(r.n >= 900 for r in counts)


def test_survival_folds_and_leave_one_out(spark):
    df, spec, pdf = matrix(spark, n=53)
    f = splitting.survival_folds(df, spec, 5).toPandas().fold.value_counts()
    assert set(f.index) == {1, 2, 3, 4, 5} and f.max() - f.min() <= 1
    assert sorted(splitting.leave_one_out(df, spec).toPandas().fold) == list(range(53))


def test_balancers(spark):
    df, spec, pdf = matrix(spark, n=90)
    pdf = pd.concat([pdf[pdf.label == 0], pdf[pdf.label == 1].head(12)])
    df = spark.createDataFrame(pdf)
    big = (pdf.label == 0).sum()
    up = balance.up_sample(df, spec).toPandas()
    assert up.label.value_counts().to_dict() == {0: big, 1: big} and up.case_id.is_unique
    down = balance.down_sample(df, spec).toPandas()
    assert down.label.value_counts().to_dict() == {0: 12, 1: 12} and set(down.case_id) <= set(pdf.case_id)
    sm = balance.smote(df, spec).toPandas()
    assert sm.label.value_counts().to_dict() == {0: big, 1: big}
    made = sm[sm.neighbor_id.notna()]
    x = pdf.set_index("case_id")[list(spec.features)]
    for r in made.itertuples():
        a, b = x.loc[r.source_id].to_numpy(), x.loc[r.neighbor_id].to_numpy()
        p = np.array([getattr(r, f) for f in spec.features])
        u = ((p - a) @ (b - a)) / ((b - a) @ (b - a))
        assert -1e-9 <= u <= 1 and np.allclose(a + u * (b - a), p)
        assert pdf.set_index("case_id").label[r.neighbor_id] == 1


def test_tomek_links_are_mutual_and_opposite(spark):
    df, spec, pdf = matrix(spark, n=80, signal=0.1)
    links = balance.tomek_links(df, spec).toPandas()
    pairs = set(zip(links.case_id, links.neighbor_id))
    assert pairs and all((b, a) in pairs for a, b in pairs)
    lab = pdf.set_index("case_id").label
    assert all(lab[a] != lab[b] for a, b in pairs)
    assert balance.remove_tomek_links(df, spec).count() == 80 - len(pairs)


def test_bootstrap_weights_look_like_poisson(spark):
    df = spark.range(20_000).withColumn("id", F.col("id").cast("string"))
    w, names = balance.bootstrap_weights(df, "id", 4)
    x = w.select(*names).toPandas().to_numpy()
    assert abs(x.mean() - 1) < 0.02 and abs(x.var() - 1) < 0.04
    assert abs((x == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(x.T)[0, 1]) < 0.03


def test_balanced_holdout_passes_its_own_test(spark):
    df, spec, pdf = matrix(spark, n=200)
    clinical = spark.createDataFrame(
        pd.DataFrame({"case_id": pdf.case_id, "age": np.random.default_rng(0).normal(size=200), "sex": np.arange(200) % 2})
    )
    out = searches.balanced_holdout(df, spec, clinical, attempts=10)
    assert out.count() == 200 and out.filter("side = 'test'").count() == sum(round(n * 0.3) for n in pdf.groupby("label").size())
    out2, info = searches.cluster_holdout(df, spec, clinical, parts=2, attempts=5)
    got = {r.feature: r for r in info.collect()}
    assert got["sex"].distribution == "Category" and 0 <= got["age"].p_value <= 1 and out2.count() == 200


def test_bootstrap_weights_follow_the_cut_points_without_a_fold(spark):
    from bisect import bisect_right

    from casebook.functions.exprs import hash_uniform

    df = spark.range(300).select(F.col("id").cast("string").alias("case_id"))
    w, names = balance.bootstrap_weights(df, "case_id", 4)
    assert "aggregate(" not in w._jdf.queryExecution().optimizedPlan().toString()
    draws = w.select(*names, *[hash_uniform(F.lit(r) + 42 * 100_003, "case_id").alias(f"u{r}") for r in range(1, 5)]).collect()
    cuts = balance._poisson_cuts()
    assert all(row[n] == bisect_right(cuts, row[f"u{i}"]) for row in draws for i, n in enumerate(names, 1))
    assert max(row[n] for row in draws for n in names) >= 4
