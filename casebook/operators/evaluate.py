"""Scoring long prediction tables: ROC, PR, DeLong, cut-offs, calibration and views for plots.

Input rows: group columns (such as model and split), case_id, pred, label. All curves
come from one distinct-score table per group; sorting cost depends on the number of
distinct scores, and running totals are bucketed, so a single group may hold any share
of the rows. All groups are scored in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions import tails
from casebook.functions.exprs import col, over, ratio
from casebook.operators.firstorder import group_quantiles
from casebook.operators.prefix import bucket_count, range_splits, running_totals
from casebook.spec import MatrixSpec

Z975 = 1.959963985  # fixed value: two-sided 95 percent normal quantile
SMALL_STD = 1e-6


def score_table(preds: DataFrame, group: list[str], pred="pred", label="label") -> DataFrame:
    """One row per (group, score): p, n, before_p, before_n (strictly lower scores), total_p, total_n."""
    counts = preds.groupBy(*group, col(pred).alias("score")).agg(
        F.count_if(col(label) == 1).alias("p"), F.count_if(col(label) != 1).alias("n")
    )
    splits = range_splits(preds, pred, bucket_count(preds))
    return running_totals(counts, group, "score", ["p", "n"], splits=splits)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _at_or_above() -> tuple[Column, Column]:
    """True and false positives when everything scored at least this high is called positive."""
    return _d("total_p") - F.col("before_p"), _d("total_n") - F.col("before_n")


def roc_points(scores: DataFrame, group: list[str]) -> DataFrame:
    """score, fpr, tpr; the start point has an infinite score."""
    tp, fp = _at_or_above()
    points = scores.select(*group, "score", ratio(fp, _d("total_n")).alias("fpr"), ratio(tp, _d("total_p")).alias("tpr"))
    start = points.select(*group).distinct().select(
        *group, F.lit(float("inf")).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_points(scores: DataFrame, group: list[str]) -> DataFrame:
    tp, fp = _at_or_above()
    points = scores.select(*group, "score", ratio(tp, tp + fp).alias("precision"), ratio(tp, _d("total_p")).alias("recall"))
    end = points.select(*group).distinct().select(
        *group, F.lit(float("inf")).alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _placements() -> tuple[Column, Column]:
    """Share of negatives below a positive, and of positives above a negative; ties count half."""
    a = over(F.col("before_n") + _d("n") / 2, _d("total_n"))
    b = over(F.col("total_p") - F.col("before_p") - _d("p") / 2, _d("total_p"))
    return a, b


def _curve_aggregates() -> list[Column]:
    a, b = _placements()
    p, n, tp_all, tn_all = _d("p"), _d("n"), _d("total_p"), _d("total_n")
    tp, fp = _at_or_above()
    tp0, fp0 = tp - p, fp - n  # the neighbouring point with a higher score
    prec = ratio(tp, tp + fp)
    prec0 = F.when(tp0 + fp0 == 0, 1.0).otherwise(ratio(tp0, tp0 + fp0))
    j = ratio(tp, tp_all) - ratio(fp, tn_all)
    return [
        F.max("total_p").alias("pos"),
        F.max("total_n").alias("neg"),
        over(F.sum(p * a), F.max(tp_all)).alias("auc"),
        F.sum(p * a * a).alias("_aa"),
        F.sum(p * a).alias("_a"),
        F.sum(n * b * b).alias("_bb"),
        F.sum(n * b).alias("_b"),
        F.sum(ratio(p, tp_all) * (prec + prec0) / 2).alias("auc_pr"),
        F.max(F.struct(j.alias("j"), F.col("score").alias("score"), tp.alias("tp"), fp.alias("fp"))).alias("_best"),
    ]


def _with_delong(df: DataFrame) -> DataFrame:
    """Standard deviation and interval of the AUC from sums of squared placements."""

    def sample_var(ss, s, n):
        return over(F.greatest(over(ss - over(s * s, n), n - 1), F.lit(0.0)), n)

    var = sample_var(F.col("_aa"), F.col("_a"), _d("pos")) + sample_var(F.col("_bb"), F.col("_b"), _d("neg"))
    sure = F.col("std") < SMALL_STD
    auc = F.col("auc")
    return (
        df.withColumn("std", F.sqrt(var))
        .withColumn("ci_low", F.when(sure, auc).otherwise(auc - Z975 * F.col("std")))
        .withColumn("ci_high", F.when(sure, auc).otherwise(F.least(F.lit(1.0), auc + Z975 * F.col("std"))))
    )


def auc_with_interval(scores: DataFrame, group: list[str]) -> DataFrame:
    """group, pos, neg, auc, std, ci_low, ci_high, auc_pr."""
    res = _with_delong(scores.groupBy(*group).agg(*_curve_aggregates()))
    return res.select(*group, "pos", "neg", "auc", "std", "ci_low", "ci_high", "auc_pr")


def youden_cutoff(scores: DataFrame, group: list[str]) -> DataFrame:
    """The highest score among the maxima of tpr - fpr; infinite if nothing beats calling all negative."""
    best = scores.groupBy(*group).agg(*_curve_aggregates()).select(*group, "_best")
    cut = F.when(F.col("_best.j") > 0, F.col("_best.score")).otherwise(F.lit(float("inf")))
    return best.select(*group, cut.alias("cutoff"), F.greatest(F.col("_best.j"), F.lit(0.0)).alias("j"))


def _confusion_columns(tp: Column, fp: Column, pos: Column, neg: Column) -> dict[str, Column]:
    fn, tn = pos - tp, neg - fp
    sen, spe = ratio(tp, pos), ratio(tn, neg)
    return {
        "acc": ratio(tp + tn, pos + neg),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "sen": sen,
        "spe": spe,
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(tn, tn + fn),
        "youden": sen + spe - 1,
    }


def confusion_metrics(preds: DataFrame, group: list[str], cutoffs: DataFrame | float) -> DataFrame:
    """Counts and rates at a given cut-off (a number, or a table group -> cutoff such as the
    training cut-offs); prediction is ``score >= cutoff``."""
    if isinstance(cutoffs, DataFrame):
        on = [g for g in group if g in cutoffs.columns]
        data = preds.join(cutoffs.select(*on, "cutoff"), on)
    else:
        data = preds.withColumn("cutoff", F.lit(float(cutoffs)))
    up, positive, negative = F.col("pred") >= F.col("cutoff"), F.col("label") == 1, F.col("label") != 1
    agg = data.groupBy(*group).agg(
        F.max("cutoff").alias("cutoff"),
        F.count_if(positive | negative).alias("number"),
        F.count_if(positive).alias("pos"),
        F.count_if(negative).alias("neg"),
        F.count_if(up & positive).cast("double").alias("_tp"),
        F.count_if(up & negative).cast("double").alias("_fp"),
    )
    return agg.withColumns(_confusion_columns(F.col("_tp"), F.col("_fp"), _d("pos"), _d("neg"))).drop("_tp", "_fp")


METRICS = (
    "number pos neg auc ci_low ci_high std auc_pr cutoff mcc acc youden sen spe ppv npv"
).split()


def metric_rows(preds: DataFrame, group: list[str], cutoffs: DataFrame | None = None) -> DataFrame:
    """The full metric row of every group in one job.

    Without ``cutoffs`` each group uses its own Youden cut-off, whose confusion counts
    are already in the distinct-score table; given cut-offs (train ones, reused for the
    other splits) are joined by the group columns they carry.
    """
    scores = score_table(preds, group)
    aggs = _curve_aggregates()
    if cutoffs is not None:
        on = [g for g in group if g in cutoffs.columns]
        scores = scores.join(cutoffs.select(*on, col("cutoff").alias("_cut")), on)
        up = F.col("score") >= F.col("_cut")
        aggs += [
            F.max("_cut").alias("_cut"),
            F.coalesce(F.sum(F.when(up, F.col("p"))), F.lit(0)).cast("double").alias("_tp"),
            F.coalesce(F.sum(F.when(up, F.col("n"))), F.lit(0)).cast("double").alias("_fp"),
        ]
    res = _with_delong(scores.groupBy(*group).agg(*aggs))
    if cutoffs is None:
        better = F.col("_best.j") > 0
        res = (
            res.withColumn("_cut", F.when(better, F.col("_best.score")).otherwise(F.lit(float("inf"))))
            .withColumn("_tp", F.when(better, F.col("_best.tp")).otherwise(0.0))
            .withColumn("_fp", F.when(better, F.col("_best.fp")).otherwise(0.0))
        )
    res = res.withColumn("number", F.col("pos") + F.col("neg")).withColumn("cutoff", F.col("_cut"))
    res = res.withColumns(_confusion_columns(F.col("_tp"), F.col("_fp"), _d("pos"), _d("neg")))
    return res.select(*group, *METRICS)


def metric_texts(metrics: DataFrame, group: list[str]) -> DataFrame:
    """Metric row as text, four decimals (exact ties to the even digit) and the interval in brackets."""
    four = [m for m in METRICS if m not in ("number", "pos", "neg", "ci_low", "ci_high")]
    return metrics.select(
        *group,
        "number",
        "pos",
        "neg",
        *[F.format_string("%.4f", F.bround(m, 4)).alias(m) for m in four],
        F.format_string("[%.4f-%.4f]", F.bround("ci_low", 4), F.bround("ci_high", 4)).alias("ci"),
    )


def compare_models(pairs: DataFrame, group: list[str] = (), a="pred_a", b="pred_b", label="label") -> DataFrame:
    """DeLong test of two models on the same cases: auc_a, auc_b, z, p, log10_p.

    Cases are first combined per (label, score a, score b); placements are then
    looked up per distinct score.
    """
    group = list(group)
    is_pos = (col(label) == 1).alias("_y")
    joint = pairs.groupBy(*group, is_pos, col(a).alias("_sa"), col(b).alias("_sb")).agg(
        F.count(F.lit(1)).cast("double").alias("_k")
    )
    place_a, place_b = _placements()

    def side(score, name):
        table = score_table(pairs, group, pred=score, label=label)
        return table.select(
            *group,
            F.col("score").alias(f"_s{name}"),
            place_a.alias(f"_pos_{name}"),
            place_b.alias(f"_neg_{name}"),
            _d("total_p").alias(f"_P{name}"),
            _d("total_n").alias(f"_N{name}"),
        )

    x = joint.join(side(a, "a"), [*group, "_sa"]).join(side(b, "b"), [*group, "_sb"])
    va = F.when(F.col("_y"), F.col("_pos_a")).otherwise(F.col("_neg_a"))
    vb = F.when(F.col("_y"), F.col("_pos_b")).otherwise(F.col("_neg_b"))
    k = F.col("_k")
    per = x.groupBy(*group, "_y").agg(
        F.sum(k).alias("m"),
        (F.sum(k * va) / F.sum(k)).alias("ma"),
        (F.sum(k * vb) / F.sum(k)).alias("mb"),
        F.sum(k * va * va).alias("aa"),
        F.sum(k * vb * vb).alias("bb"),
        F.sum(k * va * vb).alias("ab"),
    )
    m = F.col("m")

    def cov(ss, x1, x2):
        return over(F.col(ss) - m * F.col(x1) * F.col(x2), (m - 1) * m)

    parts = per.groupBy(*group).agg(
        F.max(F.when(F.col("_y"), F.col("ma"))).alias("auc_a"),
        F.max(F.when(F.col("_y"), F.col("mb"))).alias("auc_b"),
        F.sum(cov("aa", "ma", "ma") + cov("bb", "mb", "mb") - 2 * cov("ab", "ma", "mb")).alias("_v"),
    )
    # rounding can leave a tiny negative variance when the two models rank alike
    z = over(F.abs(F.col("auc_a") - F.col("auc_b")), F.sqrt(F.greatest("_v", F.lit(0.0))))
    return (
        parts.withColumn("z", z)
        .withColumn("p", tails.normal_two_sided_p(F.col("z")))
        .withColumn("log10_p", tails.log10_two_sided_p(F.col("z")))
        .drop("_v")
    )


def calibration_curve(preds: DataFrame, group: list[str], bins=100) -> DataFrame:
    """Mean score and share of positives per non-empty uniform bin of [0, 1]."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("pred") * bins)).cast("int")
    return preds.groupBy(*group, b.alias("bin")).agg(
        F.avg("pred").alias("mean_pred"), F.avg(_d("label")).alias("observed"), F.count(F.lit(1)).alias("n")
    )


def brier_score(preds: DataFrame, group: list[str]) -> DataFrame:
    return preds.groupBy(*group).agg(F.avg((F.col("pred") - _d("label")) ** 2).alias("brier"))


def box_plot_rows(preds: DataFrame, group: list[str]) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier counts per group and label."""
    by = [*group, "label"]
    q = group_quantiles(preds, by, "pred", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    inside = F.col("pred").between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread)
    counted = preds.groupBy(*by, "pred").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(q, by)
        .groupBy(*by)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col("pred"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("pred"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def outlier_rows(preds: DataFrame, group: list[str]) -> DataFrame:
    """The outlying scores themselves."""
    by = [*group, "label"]
    q = group_quantiles(preds, by, "pred", {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    outside = ~F.col("pred").between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread)
    return preds.join(q, by).filter(outside).select(*by, "case_id", "pred")


def density_rows(preds: DataFrame, group: list[str], bins=20) -> DataFrame:
    """Violin shape: density of the scores in uniform bins over [0, 1], per group and label."""
    by = [*group, "label"]
    b = F.least(F.lit(bins - 1), F.floor(F.col("pred") * bins)).cast("int")
    counts = preds.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("t"))
    return counts.join(total, by).select(*by, "bin", (F.col("n") / F.col("t") * bins).alias("density"))


def waterfall(preds: DataFrame, cutoff: float) -> DataFrame:
    """Score minus cut-off with label, in ascending order (a range-partitioned sort)."""
    return preds.select("case_id", "label", (F.col("pred") - cutoff).alias("height")).orderBy("height", "case_id")


def standardised_histogram(df: DataFrame, spec: MatrixSpec, bins=10) -> DataFrame:
    """Histogram of each z-scored feature by label; bins cover the feature's range, as drawn.

    A bin does not depend on the scale, so it is taken from the raw value: no rounding of a mean or a deviation
    moves a case that lies on a border. Features of one value only are left out.
    """
    from casebook.operators.stats import per_feature

    st = {r.feature: r for r in per_feature(df, spec, {"lo": F.min, "hi": F.max}).collect()}
    usable = [f for f in spec.features if st[f].lo is not None and st[f].lo < st[f].hi]
    long = df.select(spec.label, *[col(f).cast("double").alias(f) for f in usable]).unpivot([spec.label], usable, "feature", "x")
    ends = long.groupBy("feature", spec.label).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor(over((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))))
    return (
        long.join(ends, ["feature", spec.label])
        .groupBy("feature", spec.label, F.coalesce(b, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ranked_features(values: DataFrame, n: int, ascending=False, value="value") -> DataFrame:
    """Top features by value with a sign suffix (P or N): the order of a feature bar chart."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(F.lit(0)).orderBy(order, "feature")  # one row per feature
    sign = F.when(F.col(value) < 0, "_N").otherwise("_P")
    return (
        values.withColumn("rank_no", F.row_number().over(w))
        .filter(F.col("rank_no") <= n)
        .select("rank_no", F.concat("feature", sign).alias("feature"), value)
    )


def mean_abs_top(contributions: DataFrame, features, n: int) -> DataFrame:
    """Features with the largest mean absolute contribution."""
    means = contributions.agg(*[F.avg(F.abs(col(f))).alias(f) for f in features]).unpivot(
        [], list(features), "feature", "mean_abs"
    )
    return means.orderBy(F.col("mean_abs").desc(), "feature").limit(n)
