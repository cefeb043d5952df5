"""Split searches: many candidate holdouts are drawn and tested in one job.

Ranks do not depend on a split, so values are ranked once; a candidate then only
needs sums per (seed, feature), which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions import tails
from casebook.functions.exprs import col, over
from casebook.operators.gram import cluster_features, feature_gram, representatives
from casebook.operators.merging import attach_clinical
from casebook.operators.prefix import bucket_count, range_splits, running_totals
from casebook.operators.splitting import seeded_sides
from casebook.operators.stats import distribution_type, few_valued
from casebook.spec import MatrixSpec

DIFFERENT_P = 0.05


def text_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text columns by a repeatable number per value (only equality matters for them)."""
    texts = [c for c, t in df.dtypes if c in columns and t == "string"]
    return df.withColumns({c: (F.xxhash64(col(c)) / F.lit(4096)).cast("double") for c in texts})


def seeded_tests(df: DataFrame, spec: MatrixSpec, sides: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """p-value of every (seed, feature): ``kinds`` maps a feature to Category, Normal or Non-normal."""
    long = spec.long(df).select(spec.case_id, "feature", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(
        counts, ["feature"], "value", ["n"], splits=range_splits(long, "value", bucket_count(df))
    )
    numeric = [f for f, k in kinds.items() if k == "Non-normal"]
    normal = [f for f, k in kinds.items() if k == "Normal"]
    categories = [f for f, k in kinds.items() if k == "Category"]

    n3 = F.col("n").cast("double")
    tie = ranked.groupBy("feature").agg(F.sum(n3 * n3 * n3 - n3).alias("ties"), F.max("total_n").alias("total"))
    mid = ranked.filter(F.col("feature").isin(numeric)).select(
        "feature", "value", (F.col("before_n") + (F.col("n") + 1) / 2).alias("mid")
    )
    test = F.col("side") == "test"
    v = F.col("value")
    # Rank of every case value first, then candidates: the big join happens once, not per seed.
    numbers = (
        long.filter(F.col("feature").isin(numeric + normal))
        .join(mid, ["feature", "value"], "left")
        .join(sides, spec.case_id)
        .groupBy("seed", "feature")
        .agg(
            F.count_if(test).cast("double").alias("m"),
            F.count_if(~test).cast("double").alias("k"),
            F.sum(F.when(test, F.col("mid"))).alias("rank_sum"),
            F.avg(F.when(test, v)).alias("mean1"),
            F.avg(F.when(~test, v)).alias("mean0"),
            F.var_pop(F.when(test, v)).alias("var1"),
            F.var_pop(F.when(~test, v)).alias("var0"),
        )
        .join(tie, "feature")
    )
    m, k = F.col("m"), F.col("k")
    n = m + k
    u = F.col("rank_sum") - m * (m + 1) / 2
    sd = F.sqrt(m * k / 12 * ((n + 1) - over(F.col("ties"), n * (n - 1))))
    z = F.when(sd > 0, F.greatest((F.abs(u - m * k / 2) - 0.5) / sd, F.lit(0.0)))
    pooled = over(m * F.col("var1") + k * F.col("var0"), n - 2)
    se = F.sqrt(pooled * (over(F.lit(1.0), m) + over(F.lit(1.0), k)))
    t = F.when(se > 0, (F.col("mean1") - F.col("mean0")) / se)
    p_num = F.when(F.col("feature").isin(normal), tails.t_p(t, n - 2)).otherwise(
        F.least(F.lit(1.0), tails.normal_two_sided_p(z))
    )
    out = numbers.select("seed", "feature", F.coalesce(p_num, F.lit(1.0)).alias("p"))
    if not categories:
        return out
    cells = (
        long.filter(F.col("feature").isin(categories))
        .join(sides, spec.case_id)
        .groupBy("seed", "feature", "value")
        .agg(F.count_if(test).cast("double").alias("o1"), F.count_if(~test).cast("double").alias("o0"))
    )
    margins = cells.groupBy("seed", "feature").agg(
        F.sum("o1").alias("t1"), F.sum("o0").alias("t0"), (F.count(F.lit(1)) - 1).alias("dof")
    )
    c = cells.join(margins, ["seed", "feature"])
    row = F.col("o1") + F.col("o0")
    e1 = row * F.col("t1") / (F.col("t1") + F.col("t0"))
    e0 = row * F.col("t0") / (F.col("t1") + F.col("t0"))
    gap = F.abs(F.col("o1") - e1)
    gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    stat = c.groupBy("seed", "feature").agg(
        F.sum(gap * gap * (over(F.lit(1.0), e1) + over(F.lit(1.0), e0))).alias("chi2"), F.max("dof").alias("dof")
    )
    p_cat = F.when(F.col("dof") > 0, tails.chi2_p(F.col("chi2"), F.greatest("dof", F.lit(1)))).otherwise(1.0)
    return out.unionByName(stat.select("seed", "feature", p_cat.alias("p")))


def _side_features(clinical: DataFrame, spec: MatrixSpec) -> MatrixSpec:
    return MatrixSpec(
        tuple(sorted(c for c in clinical.columns if c != spec.case_id and c.lower() != "label")), spec.case_id, None
    )


def balanced_holdout(df: DataFrame, spec: MatrixSpec, clinical: DataFrame, fraction=0.3, attempts=100) -> DataFrame:
    """The first of ``attempts`` random holdouts in which no clinical feature differs between the
    sides (p < 0.05); one more plain holdout when all fail. Adds ``side``."""
    cspec = _side_features(clinical, spec)
    coded = text_codes(clinical, list(cspec.features))
    few = set(few_valued(coded, cspec))
    texts = {c for c, t in clinical.dtypes if t == "string"}
    kinds = {f: "Category" if f in few or f in texts else "Non-normal" for f in cspec.features}
    sides = seeded_sides(df, spec, fraction, list(range(attempts)))
    p = seeded_tests(coded, cspec, sides, kinds)
    passing = p.groupBy("seed").agg(F.min("p").alias("worst")).filter(F.col("worst") >= DIFFERENT_P)
    first = passing.agg(F.min("seed").alias("s")).head().s
    chosen = seeded_sides(df, spec, fraction, [attempts if first is None else first])
    return df.join(chosen.select(spec.case_id, "side"), spec.case_id)


def cluster_holdout(
    df: DataFrame, spec: MatrixSpec, clinical: DataFrame | None = None, parts=30, attempts=100, fraction=0.3
) -> tuple[DataFrame, DataFrame]:
    """(matrix with ``side``, info): the holdout with the highest mean p over one feature per cluster
    and the clinical features. Info: feature, p_value, distribution."""
    gram = feature_gram(df, spec, scaling="minmax")
    groups = cluster_features(gram, parts)
    tested = sorted(representatives(gram, groups))
    picked = spec.only(tested)
    table = picked.project(df)
    texts: set[str] = set()
    if clinical is not None:
        side = _side_features(clinical, spec)
        texts = {c for c, t in clinical.dtypes if t == "string" and c in side.features}
        table = attach_clinical(table, text_codes(clinical, list(side.features)), spec)
        picked = picked.only(sorted({*tested, *side.features}))
    kinds = {r.feature: r.distribution for r in distribution_type(table, picked).collect()}
    kinds.update({f: "Category" for f in texts})
    sides = seeded_sides(df, spec, fraction, list(range(attempts)))
    p = seeded_tests(table, picked, sides, kinds)
    best = (
        p.groupBy("seed").agg(F.avg("p").alias("mean_p")).agg(F.max_by("seed", F.struct("mean_p", -F.col("seed"))).alias("s")).head().s
    )
    chosen = seeded_sides(df, spec, fraction, [best])
    info = p.filter(F.col("seed") == best).select(
        "feature",
        F.col("p").alias("p_value"),
        F.coalesce(*[F.when(F.col("feature") == f, F.lit(k)) for f, k in kinds.items()]).alias("distribution"),
    )
    return df.join(chosen.select(spec.case_id, "side"), spec.case_id), info
