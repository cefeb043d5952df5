"""Ranking features against the label and keeping the best ones.

A score table does not depend on how many features are kept, so it is computed once
and cut for every k. Every scorer returns rows (feature, score) with larger better.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.exprs import col, sum_of
from casebook.operators.batch_linear import Task, solve
from casebook.operators.blocks import MAIN, packed, wide_table
from casebook.operators.gram import cluster_features, feature_gram
from casebook.operators.firstorder import group_quantiles
from casebook.operators.neighbors import nearest
from casebook.operators.normalize import apply_l2, l2_norms
from casebook.operators.prefix import numbered
from casebook.operators.stats import anova_f, kruskal_wallis, rank_sums, two_side_counts
from casebook.session import kept
from casebook.spec import MatrixSpec

RFE_SHARE = 0.05
RELIEFF_NEIGHBORS = 100


def anova_scores(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    return anova_f(df, spec).select("feature", F.col("f").alias("score"), F.col("p_f").alias("p"))


def kruskal_scores(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    res = kruskal_wallis(rank_sums(two_side_counts(df, spec, col(spec.label) == 1)))
    return res.select("feature", F.col("h").alias("score"), F.col("p_kw").alias("p"))


def relief_weights(df: DataFrame, spec: MatrixSpec, ratio: float = 1.0) -> DataFrame:
    """Relief: for the first ``int(ratio * n)`` cases, squared gaps to the nearest other-label case
    minus squared gaps to the nearest same-label case, summed per feature: feature, weight."""
    norms = l2_norms(df, spec)
    anchors = None
    if ratio < 1:
        take = int(ratio * df.count())
        anchors = numbered(df.select(spec.case_id), [], spec.case_id).filter(F.col("row_no") <= take)
    near = nearest(df, spec, 1, by_class=True, anchors=anchors, scale=norms)
    feats = spec.features
    own = df.select(
        col(spec.case_id).alias("case_id"), F.array(*[col(f).cast("double") / F.lit(norms[f]) for f in feats]).alias("vec")
    )
    both = near.join(own, "case_id")
    sign = F.when(F.col("kind") == "miss", 1.0).otherwise(-1.0)
    sums = both.agg(
        *[F.sum(sign * (F.col("vec")[i] - F.col("neighbor")[i]) ** 2).alias(f) for i, f in enumerate(feats)]
    )
    return sums.unpivot([], list(feats), "feature", "weight")


def relief_scores(df: DataFrame, spec: MatrixSpec, ratio: float = 1.0) -> DataFrame:
    return relief_weights(df, spec, ratio).select("feature", F.abs("weight").alias("score"), "weight")


def relieff_scores(df: DataFrame, spec: MatrixSpec, neighbors=RELIEFF_NEIGHBORS) -> DataFrame:
    """ReliefF with equality codes: +1 for equal and -1 for different, for label and feature alike;
    the score sums their products over the nearest neighbours of every case."""
    near = nearest(df, spec, neighbors)
    own = df.select(
        col(spec.case_id).alias("case_id"), F.array(*[col(f).cast("double") for f in spec.features]).alias("vec")
    )
    both = near.join(own, "case_id")
    lab = F.when(F.col("label") == F.col("neighbor_label"), 1).otherwise(-1)
    sums = both.agg(
        *[
            F.sum(lab * F.when(F.col("vec")[i] == F.col("neighbor")[i], 1).otherwise(-1)).alias(f)
            for i, f in enumerate(spec.features)
        ]
    )
    return sums.unpivot([], list(spec.features), "feature", "score")


def _rfe_paths(wide: DataFrame, groups: list[tuple[str, ...]], least: int, share: float, c: float, max_iter: int):
    """Recursive elimination with a linear SVM in every group of columns of a wide table (``blocks``), side by side.

    Yields for each round a list of (columns left, the same from weakest to strongest, columns that go), None for
    groups that are down to ``least``. Columns are divided by their length first; all groups share each pass.
    """
    names = sorted({f for g in groups for f in g})
    row = wide.agg(*[F.sqrt(F.sum(col(f) * col(f))).alias(f) for f in names]).head()
    data = packed(wide.withColumns({f: col(f) / F.lit(row[f] or 1.0) for f in names}))
    left = [list(g) for g in groups]
    steps = [max(1, int(share * len(g))) for g in groups]
    start: list[tuple | None] = [None] * len(groups)
    while any(len(own) > least for own in left):
        open_ = [i for i, own in enumerate(left) if len(own) > least]
        tasks = [Task(data.index(left[i]), MAIN, hinge=True, l2=1 / c, start=start[i], tol=1e-3, max_iter=max_iter) for i in open_]
        rounds: list = [None] * len(groups)
        for i, fit in zip(open_, solve(data, tasks)):
            order = [left[i][k] for k in np.argsort(np.square(fit.coef), kind="stable")]
            rounds[i] = (left[i], order, min(steps[i], len(left[i]) - least), steps[i])
            gone = set(order[: rounds[i][2]])
            start[i] = (*[w for f, w in zip(left[i], fit.coef) if f not in gone], fit.intercept)
            left[i] = [f for f in left[i] if f not in gone]
        yield rounds
    data.release()


def _rfe_table(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    return wide_table(df, spec, {f: col(f) for f in spec.features}, F.lit(MAIN))


def rfe_ranks(df: DataFrame, spec: MatrixSpec, keep: int, share=RFE_SHARE, c=1.0, max_iter=100) -> list[dict]:
    """Recursive elimination with a linear SVM: rank 1 for the kept features, larger for earlier losers.

    Each round drops the weakest ``share`` of the original feature count (at least one).
    """
    rounds = [r[1][: r[2]] for (r,) in _rfe_paths(_rfe_table(df, spec), [spec.features], keep, share, c, max_iter)]
    rank = dict.fromkeys(spec.features, 1)
    for back, drop in enumerate(reversed(rounds), start=2):
        rank.update(dict.fromkeys(drop, back))
    return [{"feature": f, "rank": rank[f]} for f in spec.features]


def rfe_together(
    wide: DataFrame, groups: list[tuple[str, ...]], keeps: list[int], share=RFE_SHARE, c=1.0, max_iter=100
) -> list[dict[int, list[str]]]:
    """What elimination keeps of each group for every number of ``keeps``, from one run down to the least of them.

    A number between two rounds drops only as many of the later round's weakest as it must, as a run that ends there would.
    """
    out = [{k: list(g) for k in keeps if k >= len(g)} for g in groups]
    for rounds in _rfe_paths(wide, groups, min(keeps), share, c, max_iter):
        for found, own in zip(out, rounds):
            if own is not None:
                left, order, _, step = own
                for k in keeps:
                    if len(left) - step <= k < len(left):
                        gone = set(order[: len(left) - k])
                        found[k] = [f for f in left if f not in gone]
    return out


def rfe_subsets(df: DataFrame, spec: MatrixSpec, keeps: list[int]) -> dict[int, list[str]]:
    return rfe_together(_rfe_table(df, spec), [spec.features], keeps)[0]


def quantile_bins(df: DataFrame, spec: MatrixSpec, bins=4) -> DataFrame:
    """Replace every feature by its exact quantile bin 0 .. bins-1 (cut points are a few numbers per feature)."""
    long = spec.long(df).select("feature", "value").filter("value IS NOT NULL")
    found = group_quantiles(long, ["feature"], "value", {f"q{i}": i / bins for i in range(1, bins)}).collect()
    cuts = {r.feature: sorted({r[f"q{i}"] for i in range(1, bins)}) for r in found}
    bin_no = {f: sum_of([F.lit(0), *[(col(f) > F.lit(v)).cast("int") for v in cuts.get(f, [])]]) for f in spec.features}
    return df.select(*spec.keys, *[bin_no[f].alias(f) for f in spec.features])


def mutual_information(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """MI (nats) of every pair of discrete columns, label included: a, b, mi.

    All contingency tables come from one aggregate over (pair, value, value); the
    pairs of one case are unfolded inside the map side and combined before the shuffle.
    """
    names = [*spec.features, spec.label]
    vals = df.select(F.array(*[col(c).cast("int") for c in names]).alias("v"))
    # Equal rows count once: discrete rows repeat a lot.
    rows = vals.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.select("v", "n", F.posexplode("v").alias("i", "x")).filter(F.col("i") < len(names) - 1)
    both = firsts.select("v", "n", "i", "x", F.explode(F.sequence(F.col("i") + 1, F.lit(len(names) - 1))).alias("j"))
    cells = both.groupBy("i", "j", "x", F.element_at("v", F.col("j") + 1).alias("y")).agg(F.sum("n").cast("double").alias("n"))
    # sum p(x,y) log p(x,y)/(p(x)p(y)) = (S_xy - S_x - S_y) / N + log N with S = sum n log n
    px = cells.groupBy("i", "j", "x").agg(F.sum("n").alias("n")).groupBy("i", "j").agg(
        F.sum(F.col("n") * F.log("n")).alias("sx")
    )
    py = cells.groupBy("i", "j", "y").agg(F.sum("n").alias("n")).groupBy("i", "j").agg(
        F.sum(F.col("n") * F.log("n")).alias("sy")
    )
    pxy = cells.groupBy("i", "j").agg(F.sum(F.col("n") * F.log("n")).alias("sxy"), F.sum("n").alias("t"))
    lit_names = F.array(*[F.lit(c) for c in names])
    mi = (F.col("sxy") - F.col("sx") - F.col("sy")) / F.col("t") + F.log("t")
    return (
        pxy.join(px, ["i", "j"])
        .join(py, ["i", "j"])
        .select(
            F.element_at(lit_names, F.col("i") + 1).alias("a"),
            F.element_at(lit_names, F.col("j") + 1).alias("b"),
            mi.alias("mi"),
        )
    )


def mrmr(df: DataFrame, spec: MatrixSpec, k: int, bins=4) -> list[str]:
    """Greedy pick of k features by relevance minus mean redundancy (mutual information difference)."""
    table = {}
    for r in mutual_information(quantile_bins(df, spec, bins), spec).collect():  # p^2 numbers
        table[r.a, r.b] = table[r.b, r.a] = r.mi
    chosen: list[str] = []
    rest = list(spec.features)
    while rest and len(chosen) < k:
        gain = [
            table[f, spec.label] - (sum(table[f, g] for g in chosen) / len(chosen) if chosen else 0.0) for f in rest
        ]
        best = rest[int(np.argmax(gain))]
        chosen.append(best)
        rest.remove(best)
    return chosen


def cluster_subsets(df: DataFrame, spec: MatrixSpec, keeps: list[int]) -> dict[int, list[str]]:
    """One feature per feature cluster for every number of clusters: the one that correlates most with the event."""
    g = feature_gram(df, spec, with_label=True)
    r = np.abs(np.nan_to_num(g.corr[:-1, -1]))
    found = {}
    for k in keeps:
        labels = cluster_features(g.sub(spec.features), k) if k > 1 else np.zeros(len(r), dtype=int)
        own = [np.flatnonzero(labels == c) for c in range(int(labels.max()) + 1)]
        found[k] = [spec.features[m[r[m].argmax()]] for m in own if len(m)]
    return found


def cluster_pick(df: DataFrame, spec: MatrixSpec, k: int) -> list[str]:
    return cluster_subsets(df, spec, [k])[k]


def ranked(scores: DataFrame, spec: MatrixSpec, ascending=False) -> DataFrame:
    """Add ``rank_no``; ties keep feature order and undefined scores come last.

    One row per feature, so ordering them in one place is bounded by the schema.
    """
    place = F.array_position(F.array(*[F.lit(f) for f in spec.features]), F.col("feature"))
    key = F.col("score").asc_nulls_last() if ascending else F.col("score").desc_nulls_last()
    w = Window.partitionBy(F.lit(0)).orderBy(key, place)
    return scores.withColumn("rank_no", F.row_number().over(w))


def top_features(scores: DataFrame, spec: MatrixSpec, k: int) -> list[str]:
    return [r.feature for r in ranked(scores, spec).filter(F.col("rank_no") <= k).orderBy("rank_no").collect()]


def _by_score(scorer) -> Callable:
    return lambda df, spec, k: top_features(scorer(df, spec), spec, k)


def _rfe(df, spec, k):
    return [r["feature"] for r in rfe_ranks(df, spec, min(k, len(spec.features))) if r["rank"] == 1]


# A selector is any callable (df, spec, k) -> list of feature names; register new ones here.
SELECTORS: dict[str, Callable] = {
    "All": lambda df, spec, k: list(spec.features),
    "ANOVA": _by_score(anova_scores),
    "KW": _by_score(kruskal_scores),
    "Relief": _by_score(relief_scores),
    "ReliefF": _by_score(relieff_scores),
    "RFE": _rfe,
    "mRMR": mrmr,
    "Cluster": cluster_pick,
}
#: Selectors that give the features for many numbers in one run, and for many groups of columns side by side.
NESTED: dict[str, Callable] = {"RFE": rfe_subsets, "Cluster": cluster_subsets}
TOGETHER: dict[str, Callable] = {"RFE": rfe_together}
SCORERS: dict[str, Callable] = {"ANOVA": anova_scores, "KW": kruskal_scores, "Relief": relief_scores}


def select_chain(df: DataFrame, spec: MatrixSpec, steps: list[tuple[str | Callable, int]]) -> MatrixSpec:
    """Run selectors one after the other; each narrows the features for the next."""
    for method, k in steps:
        fn = SELECTORS[method] if isinstance(method, str) else method
        spec = spec.only(fn(df, spec, k))
    return spec
