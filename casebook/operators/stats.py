"""Statistics per feature: aggregates, two-sample tests, distribution type, rater agreement.

Everything is one row per feature at the end; case rows only pass through
mergeable aggregates or through distinct-value counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions import tails
from casebook.functions.exprs import col, over
from casebook.operators.firstorder import group_quantiles
from casebook.operators.prefix import bucket_count, range_splits, running_totals
from casebook.spec import MatrixSpec

CATEGORY_LIMIT = 9
NORMAL_P = 0.05


def per_feature(df: DataFrame, spec: MatrixSpec, makers: dict, by: list[str] = ()) -> DataFrame:
    """``makers`` maps an output name to ``fn(column) -> aggregate``; result: by..., feature, outputs.

    Cases are unfolded to (feature number, value) next to their other columns, which the makers may
    read, and summed per feature before they are shuffled: one form for any number of features.
    """
    if not spec.features:
        raise ValueError("no feature to aggregate")
    by = list(by)
    others = [col(c) for c in df.columns if c not in spec.features]
    cells = F.posexplode(F.array(*[col(f).cast("double") for f in spec.features])).alias("_no", "_cell")
    sums = df.select(*others, cells).groupBy(*by, "_no").agg(*[fn(F.col("_cell")).alias(n) for n, fn in makers.items()])
    name = F.element_at(F.array(*[F.lit(f) for f in spec.features]), F.col("_no") + 1).alias("feature")
    return sums.select(*by, name, *makers)


def precise_sum(c: Column) -> Column:
    """The sum of whole parts, which is exact, and that of the rests: a plain sum of many large values loses decimals."""
    splits = F.abs(c) < float(1 << 52)
    return F.sum(F.when(splits, F.rint(c)).otherwise(c)) + F.sum(F.when(splits, c - F.rint(c)).otherwise(F.when(c.isNotNull(), 0.0)))


def describe(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    base = per_feature(
        df,
        spec,
        {
            "n": F.count,
            "total": precise_sum,
            "mean": F.avg,
            "sd": F.stddev_pop,
            "low": F.min,
            "high": F.max,
        },
    )
    long = spec.long(df).select("feature", "value")
    distinct = long.groupBy("feature", "value").agg(F.lit(1).alias("_one")).groupBy("feature").agg(
        F.count("value").alias("n_distinct")
    )
    q = group_quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return base.join(distinct, "feature").join(q, "feature")


def few_valued(df: DataFrame, spec: MatrixSpec, limit: int = CATEGORY_LIMIT) -> list[str]:
    """Features with at most ``limit`` distinct values, without counting all distinct values.

    A sketch that has seen at most ``limit`` values has at most that many filled
    registers, so its estimate cannot exceed limit + 1; only features below that
    are counted exactly, and those have few values.
    """
    est = df.agg(*[F.approx_count_distinct(col(f)).alias(f) for f in spec.features]).head()
    maybe = [f for f in spec.features if est[f] <= limit + 1]
    if not maybe:
        return []
    exact = df.agg(*[F.count_distinct(col(f)).alias(f) for f in maybe]).head()
    return [f for f in maybe if exact[f] <= limit]


def two_side_counts(df: DataFrame, spec: MatrixSpec, side: Column, ranks=True) -> DataFrame:
    """Distinct-value table: feature, value, n1 (side true), n0, n, and running totals when ``ranks``.

    Missing values, and cases on neither side, are not counted: sizes are those of the cells there are.
    """
    long = df.withColumn("_side", side.cast("boolean")).unpivot(
        ["_side"], [col(f).cast("double").alias(f) for f in spec.features], "feature", "value"
    ).filter("value IS NOT NULL AND _side IS NOT NULL")
    counts = long.groupBy("feature", "value").agg(
        F.count_if("_side").alias("n1"), F.count_if(~F.col("_side")).alias("n0"), F.count(F.lit(1)).alias("n")
    )
    if not ranks:
        return counts
    splits = range_splits(long, "value", bucket_count(df))
    return running_totals(counts, ["feature"], "value", ["n", "n1", "n0"], splits=splits)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def rank_sums(counts: DataFrame) -> DataFrame:
    """Per feature: sizes, rank sum of side 1, tie term and chi-square pieces from ``two_side_counts``."""
    midrank = F.col("before_n") + (F.col("n") + 1) / 2
    return counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.max("total_n1").cast("double").alias("m1"),
        F.max("total_n0").cast("double").alias("m0"),
        F.sum(_d("n1") * midrank).alias("rank_sum"),
        F.sum(_d("n") * _d("n") * _d("n") - _d("n")).alias("ties"),
        *_chi_pieces(),
    )


def _chi_pieces() -> list[Column]:
    """Sums over distinct values for the contingency chi-square, without and with continuity correction."""
    e1 = _d("n") * F.col("total_n1") / F.col("total_n")
    e0 = _d("n") * F.col("total_n0") / F.col("total_n")
    weight = over(F.lit(1.0), e1) + over(F.lit(1.0), e0)
    gap = F.abs(_d("n1") - e1)
    soft = gap - F.least(F.lit(0.5), gap)
    return [F.sum(gap * gap * weight).alias("chi2_plain"), F.sum(soft * soft * weight).alias("chi2_yates")]


def mann_whitney(sums: DataFrame) -> DataFrame:
    """U of side 1, z with continuity and tie correction, two-sided normal p."""
    m, k = F.col("m1"), F.col("m0")
    n = m + k
    u = F.col("rank_sum") - m * (m + 1) / 2
    sd = F.sqrt(m * k / 12 * ((n + 1) - over(F.col("ties"), n * (n - 1))))
    z = F.when(sd > 0, (F.abs(u - m * k / 2) - 0.5) / sd)
    return sums.withColumn("u", u).withColumn("z", z).withColumn(
        "p_mw", F.least(F.lit(1.0), tails.normal_two_sided_p(F.greatest(F.col("z"), F.lit(0.0))))
    )


def kruskal_wallis(sums: DataFrame) -> DataFrame:
    """H for two groups with tie correction; p has one degree of freedom."""
    m, k = F.col("m1"), F.col("m0")
    n = m + k
    r1 = F.col("rank_sum")
    r0 = n * (n + 1) / 2 - r1
    h = 12 / (n * (n + 1)) * (over(r1 * r1, m) + over(r0 * r0, k)) - 3 * (n + 1)
    fix = 1 - over(F.col("ties"), n * n * n - n)
    return sums.withColumn("h", F.when(fix > 0, h / fix)).withColumn("p_kw", tails.chi2_p(F.col("h"), F.lit(1.0)))


def chi_square(sums: DataFrame) -> DataFrame:
    """Contingency chi-square of value by side; continuity correction for one degree of freedom."""
    dof = F.col("n_values") - 1
    stat = F.when(dof == 1, F.col("chi2_yates")).otherwise(F.col("chi2_plain"))
    return (
        sums.withColumn("dof", dof)
        .withColumn("chi2", F.when(dof > 0, stat).otherwise(0.0))
        .withColumn("p_chi2", F.when(dof > 0, tails.chi2_p(F.col("chi2"), F.greatest(dof, F.lit(1)))).otherwise(1.0))
    )


def _class_moments(df: DataFrame, spec: MatrixSpec, side: Column) -> DataFrame:
    """n, mean and centred sum of squares per feature and side, in one row per feature."""
    s = side.cast("boolean")
    return per_feature(
        df,
        spec,
        {
            "n1": lambda c: F.count(F.when(s, c)),
            "n0": lambda c: F.count(F.when(~s, c)),
            "mean1": lambda c: F.avg(F.when(s, c)),
            "mean0": lambda c: F.avg(F.when(~s, c)),
            "var1": lambda c: F.var_pop(F.when(s, c)),
            "var0": lambda c: F.var_pop(F.when(~s, c)),
        },
    )


def t_test(df: DataFrame, spec: MatrixSpec, side: Column) -> DataFrame:
    """Pooled two-sample t: feature, t, p_t."""
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = over(n1 * F.col("var1") + n0 * F.col("var0"), n1 + n0 - 2)
    se = F.sqrt(pooled * (over(F.lit(1.0), n1) + over(F.lit(1.0), n0)))
    m = _class_moments(df, spec, side)
    return m.withColumn("t", F.when(se > 0, (F.col("mean1") - F.col("mean0")) / se)).withColumn(
        "p_t", tails.t_p(F.col("t"), n1 + n0 - 2)
    )


def anova_f(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """One-way F of every feature over the two labels: feature, f, p_f."""
    n1, n0 = F.col("n1"), F.col("n0")
    m = _class_moments(df, spec, col(spec.label) == 1)
    between = n1 * n0 / (n1 + n0) * (F.col("mean1") - F.col("mean0")) ** 2
    within = n1 * F.col("var1") + n0 * F.col("var0")
    f = F.when(within > 0, over(between * (n1 + n0 - 2), within))
    return m.withColumn("f", f).withColumn("p_f", tails.f_p(F.col("f"), F.lit(1.0), n1 + n0 - 2))


def distribution_type(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """feature, k2, p, distribution: Category, Normal or Non-normal."""
    few = few_valued(df, spec, CATEGORY_LIMIT)
    m = per_feature(df, spec, {"n": F.count, "g": F.skewness, "b": lambda c: F.kurtosis(c) + 3})
    k2 = normality_statistic(F.col("n").cast("double"), F.col("g"), F.col("b"))
    out = m.select("feature", k2.alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))
    kind = (
        F.when(F.col("feature").isin(few), "Category")
        .when(F.col("p") > NORMAL_P, "Normal")
        .otherwise("Non-normal")
    )
    return out.withColumn("distribution", kind)


def normality_statistic(n: Column, g: Column, b: Column) -> Column:
    """D'Agostino-Pearson K2 from the population skewness and (not excess) kurtosis; needs n > 3."""
    n = F.when(n > 3, n)
    y = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = F.sqrt(2 * (beta - 1)) - 1
    zs = over(F.asinh(over(y, F.sqrt(over(F.lit(2.0), w - 1)))), F.sqrt(F.log(w) / 2))
    x = over(
        b - 3 * (n - 1) / (n + 1), F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    )
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    zk = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt(over(1 - 2 / a, F.abs(d)))) / F.sqrt(2 / (9 * a))
    return zs * zs + zk * zk


def compare_features(df: DataFrame, spec: MatrixSpec, side: Column, names=("side1", "side0")) -> DataFrame:
    """Feature-by-feature comparison of two sets of cases.

    Text, and numbers of at most nine distinct values: chi-square with ``value: count`` texts;
    otherwise Mann-Whitney with ``mean+-std`` texts. A text feature of more values says how many.
    """
    kinds = dict(df.dtypes)
    texts = spec.only(f for f in spec.features if kinds[f] == "string")
    numbers = spec.only(f for f in spec.features if kinds[f] != "string")
    parts = [make(df, own, side, names) for make, own in ((_compare_numbers, numbers), (_compare_texts, texts)) if own.features]
    return reduce(DataFrame.unionByName, parts)


def _compare_texts(df: DataFrame, spec: MatrixSpec, side: Column, names) -> DataFrame:
    long = df.withColumn("_side", side.cast("boolean")).unpivot(["_side"], [col(f) for f in spec.features], "feature", "value")
    counts = long.filter("value IS NOT NULL AND _side IS NOT NULL").groupBy("feature", "value").agg(
        F.count_if("_side").alias("n1"), F.count_if(~F.col("_side")).alias("n0"), F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy("feature").agg(
        F.sum("n").alias("total_n"), F.sum("n1").alias("total_n1"), F.sum("n0").alias("total_n0"), F.count(F.lit(1)).alias("n_values")
    )
    pieces = counts.join(totals, "feature").groupBy("feature").agg(F.max("n_values").alias("n_values"), *_chi_pieces())
    res = chi_square(pieces)
    few = counts.join(totals.filter(F.col("n_values") <= CATEGORY_LIMIT).select("feature"), "feature")
    cells = few.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("value", "n1", "n0"))).alias("cells"))

    def text(n):
        listed = F.array_join(F.transform("cells", lambda c: F.format_string("%s: %d", c["value"], c[n])), ", ")
        return F.coalesce(listed, F.format_string("%d values", F.col("n_values")))

    return res.join(cells, "feature", "left").select(
        "feature",
        text("n1").alias(names[0]),
        text("n0").alias(names[1]),
        F.col("p_chi2").alias("p"),
        F.lit("Chi-Square").alias("method"),
        F.col("chi2").alias("statistic"),
    )


def _compare_numbers(df: DataFrame, spec: MatrixSpec, side: Column, names) -> DataFrame:
    few = few_valued(df, spec)
    counts = two_side_counts(df, spec, side)
    res = chi_square(mann_whitney(rank_sums(counts)))
    moments = _class_moments(df, spec, side)
    is_cat = F.col("feature").isin(few)
    # at most nine value texts per feature
    texts = counts.filter(is_cat).groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("value", "n1", "n0"))).alias("cells")
    )

    def text(n, mean, var):
        cat = F.array_join(
            F.transform("cells", lambda c: F.format_string("%s: %d", c["value"].cast("string"), c[n])), ", "
        )
        num = F.format_string("%.2f+-%.2f", F.col(mean), F.sqrt(F.col(var)))
        return F.when(is_cat, cat).otherwise(num)

    return (
        res.join(moments.drop("n1", "n0"), "feature")
        .join(texts, "feature", "left")
        .select(
            "feature",
            text("n1", "mean1", "var1").alias(names[0]),
            text("n0", "mean0", "var0").alias(names[1]),
            F.when(is_cat, F.col("p_chi2")).otherwise(F.col("p_mw")).alias("p"),
            F.when(is_cat, "Chi-Square").otherwise("Mann-Whitney").alias("method"),
            F.when(is_cat, F.col("chi2")).otherwise(F.col("u")).alias("statistic"),
        )
    )


def icc(a: DataFrame, b: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Agreement of two raters over the same cases: feature, icc1, icc2, icc3 (undefined -> 1)."""
    left = a.select(spec.case_id, *[col(f).cast("double").alias(f"a_{f}") for f in spec.features])
    right = b.select(spec.case_id, *[col(f).cast("double").alias(f"b_{f}") for f in spec.features])
    joined = left.join(right, spec.case_id)
    row = joined.agg(
        *[
            F.struct(
                F.count(F.lit(1)).cast("double").alias("n"),
                F.var_pop((col(f"a_{f}") + col(f"b_{f}")) / 2).alias("between"),
                F.avg((col(f"a_{f}") - col(f"b_{f}")) ** 2).alias("gap2"),
                F.avg(col(f"a_{f}") - col(f"b_{f}")).alias("gap"),
            ).alias(f)
            for f in spec.features
        ]
    )
    parts = ("n", "between", "gap2", "gap")
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}`.{k}").alias(k) for k in parts]) for f in spec.features]
    )
    m = row.select(F.inline(cells))
    n = F.col("n")
    ss_within = n * F.col("gap2") / 2
    ss_raters = n * F.col("gap") * F.col("gap") / 2
    msb = over(2 * n * F.col("between"), n - 1)
    msw = ss_within / n
    msj = ss_raters
    mse = over(ss_within - ss_raters, n - 1)

    def safe(num, den):
        return F.coalesce(over(num, den), F.lit(1.0))

    return m.select(
        "feature",
        safe(msb - msw, msb + msw).alias("icc1"),
        safe(msb - mse, msb + mse + 2 * (msj - mse) / n).alias("icc2"),
        safe(msb - mse, msb + mse).alias("icc3"),
    )


def label_correlation(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Absolute Pearson correlation of each feature with the label."""
    return per_feature(df, spec, {"r": lambda c: F.abs(F.corr(c, col(spec.label).cast("double")))})
