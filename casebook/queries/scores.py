"""Evaluation of prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import rounded
from casebook.operators import evaluate as e
from casebook.queries import query
from casebook.queries.sql import OM, PP, PR, normal_p, r
from casebook.sources import kept_tables as t
from casebook.sources.tables import ORDER_FEATURES

G = ["model", "split"]

# Distinct-score table d and per-row columns of c; sums come after.
SCORES = f"""{PR},
d AS (SELECT model, split, pred AS score, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS n FROM pr GROUP BY 1, 2, 3),
c AS (SELECT *, sum(p) OVER w - p AS bp, sum(n) OVER w - n AS bn, sum(p) OVER g AS tp_all, sum(n) OVER g AS tn_all FROM d
 WINDOW w AS (PARTITION BY model, split ORDER BY score), g AS (PARTITION BY model, split)),
s AS (SELECT *, tp_all - bp AS tp, tn_all - bn AS fp, (bn + n / 2) / tn_all AS a, (tp_all - bp - p / 2) / tp_all AS b,
 (tp_all - bp) / tp_all - (tn_all - bn) / tn_all AS j FROM c),
u AS (SELECT model, split, max(tp_all) AS pos, max(tn_all) AS neg, sum(p * a) / max(tp_all) AS auc,
 sum(p / tp_all * (tp / (tp + fp) + CASE WHEN tp - p + fp - n = 0 THEN 1 ELSE (tp - p) / (tp - p + fp - n) END) / 2) AS auc_pr FROM s GROUP BY 1, 2),
v AS (SELECT s.model, s.split, sqrt(sum(p * (a - auc) ** 2) / ((max(pos) - 1) * max(pos)) + sum(n * (b - auc) ** 2) / ((max(neg) - 1) * max(neg))) AS std
 FROM s JOIN u ON s.model = u.model AND s.split = u.split GROUP BY 1, 2),
y AS (SELECT model, split, CASE WHEN j > 0 THEN score ELSE 'inf'::DOUBLE END AS cutoff, greatest(j, 0) AS j,
 CASE WHEN j > 0 THEN tp ELSE 0 END AS tp, CASE WHEN j > 0 THEN fp ELSE 0 END AS fp FROM s
 QUALIFY row_number() OVER (PARTITION BY model, split ORDER BY s.j DESC, score DESC) = 1)"""


def rnd(df, group, skip=()):
    return df.select(
        *[rounded(c).alias(c) if dt == "double" and c not in skip else F.col(c) for c, dt in df.dtypes]
    )


@query(
    "roc_points",
    f"WITH {SCORES} SELECT model, split, score, {r('fp / tn_all')} AS fpr, {r('tp / tp_all')} AS tpr FROM s "
    "UNION ALL SELECT model, split, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM u",
)
def roc_points(spark, sf):
    return rnd(e.roc_points(e.score_table(t.predictions(spark, sf), G), G), G, skip=("score",))


@query(
    "auc_delong",
    f"WITH {SCORES} SELECT u.model, u.split, pos::BIGINT AS pos, neg::BIGINT AS neg, {r('auc')} AS auc, {r('std')} AS std, "
    f"{r('auc - 1.959963985 * std')} AS ci_low, {r('least(1, auc + 1.959963985 * std)')} AS ci_high, {r('auc_pr')} AS auc_pr "
    "FROM u JOIN v ON u.model = v.model AND u.split = v.split",
)
def auc_delong(spark, sf):
    return rnd(e.auc_with_interval(e.score_table(t.predictions(spark, sf), G), G), G)


@query(
    "auc_trapezoid",
    f"WITH {SCORES} SELECT model, split, {r('sum((fp / tn_all - (fp - n) / tn_all) * (tp / tp_all + (tp - p) / tp_all) / 2)')} AS auc "
    "FROM s GROUP BY 1, 2",
)
def auc_trapezoid(spark, sf):
    """The midrank AUC equals the area under the ROC points."""
    out = e.auc_with_interval(e.score_table(t.predictions(spark, sf), G), G)
    return out.select(*G, rounded("auc").alias("auc"))


_DELONG = f"""{PP},
q AS (SELECT *, rank() OVER (ORDER BY pred_a) + (count(*) OVER (PARTITION BY pred_a) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (ORDER BY pred_b) + (count(*) OVER (PARTITION BY pred_b) - 1) / 2.0::DOUBLE AS rb,
 rank() OVER (PARTITION BY label ORDER BY pred_a) + (count(*) OVER (PARTITION BY label, pred_a) - 1) / 2.0::DOUBLE AS wa,
 rank() OVER (PARTITION BY label ORDER BY pred_b) + (count(*) OVER (PARTITION BY label, pred_b) - 1) / 2.0::DOUBLE AS wb,
 count(*) FILTER (WHERE label = 1) OVER () AS m, count(*) FILTER (WHERE label = 0) OVER () AS n FROM pp),
w AS (SELECT label, m, n, CASE WHEN label = 1 THEN (ra - wa) / n ELSE 1 - (ra - wa) / m END AS va,
 CASE WHEN label = 1 THEN (rb - wb) / n ELSE 1 - (rb - wb) / m END AS vb FROM q),
s AS (SELECT label, avg(va) AS ma, avg(vb) AS mb, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) AS v FROM w GROUP BY 1),
f AS (SELECT max(ma) FILTER (WHERE label = 1) AS auc_a, max(mb) FILTER (WHERE label = 1) AS auc_b, sum(v) AS v FROM s)"""


@query(
    "delong_comparison",
    f"WITH {_DELONG} SELECT {r('auc_a')} AS auc_a, {r('auc_b')} AS auc_b, {r('abs(auc_a - auc_b) / sqrt(v)', 6)} AS z FROM f",
)
def delong_comparison(spark, sf):
    out = e.compare_models(t.paired_predictions(spark, sf))
    return out.select(rounded("auc_a").alias("auc_a"), rounded("auc_b").alias("auc_b"), rounded("z", 6).alias("z"))


@query(
    "delong_comparison_p",
    f"WITH {_DELONG}, z AS (SELECT *, abs(auc_a - auc_b) / sqrt(v) AS z FROM f) SELECT {r('auc_a')} AS auc_a, {r('auc_b')} AS auc_b, "
    f"{r('z', 6)} AS z, {r(normal_p('z'), 6)} AS p, {r('log10(' + normal_p('z') + ')', 5)} AS log10_p FROM z",
)
def delong_comparison_p(spark, sf):
    out = e.compare_models(t.paired_predictions(spark, sf))
    digits = {"z": 6, "p": 6, "log10_p": 5}
    return out.select(*[rounded(c, digits.get(c, 8)).alias(c) for c in ("auc_a", "auc_b", "z", "p", "log10_p")])


@query(
    "pr_points",
    f"WITH {SCORES} SELECT model, split, score, {r('tp / (tp + fp)')} AS precision, {r('tp / tp_all')} AS recall FROM s "
    "UNION ALL SELECT model, split, 'inf'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM u",
)
def pr_points(spark, sf):
    return rnd(e.pr_points(e.score_table(t.predictions(spark, sf), G), G), G, skip=("score",))


@query(
    "youden_cutoff",
    f"WITH {SCORES} SELECT model, split, cutoff, {r('j')} AS j FROM y",
)
def youden_cutoff(spark, sf):
    return rnd(e.youden_cutoff(e.score_table(t.predictions(spark, sf), G), G), G, skip=("cutoff",))


def _confusion_sql(pos="pos", neg="neg"):
    q = lambda num, den: r(f"CASE WHEN ({den}) = 0 THEN 0 ELSE ({num}) / ({den}) END")
    fn, tn = f"({pos} - tp)", f"({neg} - fp)"
    return (
        f"{q(f'tp + {tn}', f'{pos} + {neg}')} AS acc, "
        f"{q(f'tp * {tn} - fp * {fn}', f'sqrt(tp + fp) * sqrt({pos}) * sqrt({neg}) * sqrt({tn} + {fn})')} AS mcc, "
        f"{q('tp', pos)} AS sen, {q(tn, neg)} AS spe, {q('tp', 'tp + fp')} AS ppv, {q(tn, f'{tn} + {fn}')} AS npv, "
        f"{r(f'tp / {pos} + {tn} / {neg} - 1')} AS youden"
    )


@query(
    "confusion_at_cutoff",
    f"WITH {PR}, x AS (SELECT model, split, count(*) AS number, sum(label)::DOUBLE AS pos, (count(*) - sum(label))::DOUBLE AS neg, "
    "sum(CASE WHEN pred >= 0.5 THEN label ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN pred >= 0.5 THEN 1 - label ELSE 0 END)::DOUBLE AS fp "
    f"FROM pr GROUP BY 1, 2) SELECT model, split, 0.5::DOUBLE AS cutoff, number, pos::BIGINT AS pos, neg::BIGINT AS neg, {_confusion_sql()} FROM x",
)
def confusion_at_cutoff(spark, sf):
    return rnd(e.confusion_metrics(t.predictions(spark, sf), G, 0.5), G)


_METRIC_SELECT = (
    "SELECT u.model, u.split, (pos + neg)::BIGINT AS number, pos::BIGINT AS pos, neg::BIGINT AS neg, "
    f"{r('auc')} AS auc, {r('auc - 1.959963985 * std')} AS ci_low, {r('least(1, auc + 1.959963985 * std)')} AS ci_high, "
    f"{r('std')} AS std, {r('auc_pr')} AS auc_pr, cutoff, {_confusion_sql()} "
)


@query(
    "metric_rows",
    f"WITH {SCORES} {_METRIC_SELECT} FROM u JOIN v ON u.model = v.model AND u.split = v.split "
    "JOIN y ON u.model = y.model AND u.split = y.split",
)
def metric_rows(spark, sf):
    return rnd(e.metric_rows(t.predictions(spark, sf), G), G, skip=("cutoff",))


@query(
    "metric_rows_with_train_cutoff",
    f"WITH {SCORES}, tc AS (SELECT model, cutoff FROM y WHERE split = 'F'), "
    "z AS (SELECT s.model, s.split, max(tc.cutoff) AS cutoff, coalesce(sum(p) FILTER (WHERE score >= tc.cutoff), 0) AS tp, "
    "coalesce(sum(n) FILTER (WHERE score >= tc.cutoff), 0) AS fp FROM s JOIN tc ON s.model = tc.model GROUP BY 1, 2) "
    f"{_METRIC_SELECT} FROM u JOIN v ON u.model = v.model AND u.split = v.split "
    "JOIN z ON u.model = z.model AND u.split = z.split",
)
def metric_rows_with_train_cutoff(spark, sf):
    """The cut-off of one split applied to all splits of the same model."""
    preds = t.predictions(spark, sf)
    train = preds.filter(F.col("split") == "F")
    cut = e.youden_cutoff(e.score_table(train, ["model"]), ["model"]).select("model", "cutoff")
    return rnd(e.metric_rows(preds, G, cut), G, skip=("cutoff",))


_FOUR = ("auc", "std", "auc_pr", "cutoff", "mcc", "acc", "youden", "sen", "spe", "ppv", "npv")


@query(
    "metric_texts",
    f"WITH {SCORES}, t AS ({_METRIC_SELECT} FROM u JOIN v ON u.model = v.model AND u.split = v.split "
    "JOIN y ON u.model = y.model AND u.split = y.split) SELECT model, split, number, pos, neg, "
    + ", ".join(f"printf('%.4f', {c}::DOUBLE) AS {c}" for c in _FOUR)
    + ", '[' || printf('%.4f', ci_low) || '-' || printf('%.4f', ci_high) || ']' AS ci FROM t",
)
def metric_texts(spark, sf):
    return e.metric_texts(e.metric_rows(t.predictions(spark, sf), G), G)


@query(
    "calibration_curve",
    f"WITH {PR} SELECT model, least(99, floor(pred * 100))::INT AS bin, {r('avg(pred)')} AS mean_pred, {r('avg(label)')} AS observed, "
    "count(*) AS n FROM pr GROUP BY 1, 2",
)
def calibration_curve(spark, sf):
    return rnd(e.calibration_curve(t.predictions(spark, sf), ["model"]), G)


@query("brier_score", f"WITH {PR} SELECT model, split, {r('avg((pred - label) ** 2)')} AS brier FROM pr GROUP BY 1, 2")
def brier_score(spark, sf):
    return rnd(e.brier_score(t.predictions(spark, sf), G), G)


_BOX = f"""WITH {PR}, q AS (SELECT model, label, quantile_cont(pred, 0.25) AS q1, quantile_cont(pred, 0.5) AS median, quantile_cont(pred, 0.75) AS q3 FROM pr GROUP BY 1, 2),
x AS (SELECT pr.*, q1, median, q3, pred BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM pr JOIN q ON pr.model = q.model AND pr.label = q.label)"""


@query(
    "box_plot_rows",
    f"{_BOX} SELECT model, label, {r('max(q1)')} AS q1, {r('max(median)')} AS median, {r('max(q3)')} AS q3, "
    "min(pred) FILTER (WHERE inside) AS whisker_low, max(pred) FILTER (WHERE inside) AS whisker_high, "
    "count(*) FILTER (WHERE NOT inside) AS outliers FROM x GROUP BY 1, 2",
)
def box_plot_rows(spark, sf):
    return rnd(e.box_plot_rows(t.predictions(spark, sf), ["model"]), G, skip=("whisker_low", "whisker_high"))


@query("outlier_rows", f"{_BOX} SELECT model, label, case_id, pred FROM x WHERE NOT inside")
def outlier_rows(spark, sf):
    return e.outlier_rows(t.predictions(spark, sf), ["model"])


@query(
    "density_rows",
    f"WITH {PR}, b AS (SELECT model, label, least(19, floor(pred * 20))::INT AS bin, count(*)::DOUBLE AS n FROM pr GROUP BY 1, 2, 3) "
    f"SELECT model, label, bin, {r('n / sum(n) OVER (PARTITION BY model, label) * 20')} AS density FROM b",
)
def density_rows(spark, sf):
    return rnd(e.density_rows(t.predictions(spark, sf), ["model"]), G)


@query("waterfall", f"WITH {PR} SELECT case_id, label, {r('pred - 0.5')} AS height FROM pr")
def waterfall(spark, sf):
    return rnd(e.waterfall(t.predictions(spark, sf), 0.5), G)


@query(
    "standardised_histogram",
    f"""WITH {OM}, u AS (SELECT label, feature, x FROM (SELECT label, {', '.join(f'{f}::DOUBLE AS {f}' for f in ORDER_FEATURES)} FROM om)
 UNPIVOT (x FOR feature IN ({', '.join(ORDER_FEATURES)}))),
b AS (SELECT label, feature, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM u WINDOW w AS (PARTITION BY feature, label))
SELECT feature, label, coalesce(least(9, floor((x - lo) * 10::DOUBLE / nullif(hi - lo, 0))), 0)::INT AS bin, count(*) AS n FROM b GROUP BY 1, 2, 3""",
)
def standardised_histogram(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    return e.standardised_histogram(df, spec)


@query(
    "ranked_features",
    f"WITH {OM}, c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, label) AS value FROM om" for f in ("disc_avg", "lines", "price_avg", "qty_avg", "total"))
    + f") SELECT row_number() OVER (ORDER BY value DESC, feature)::INT AS rank_no, feature || CASE WHEN value < 0 THEN '_N' ELSE '_P' END AS feature, {r('value')} AS value "
    "FROM c QUALIFY row_number() OVER (ORDER BY value DESC, feature) <= 4",
)
def ranked_features(spark, sf):
    from casebook.operators.stats import per_feature

    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["disc_avg", "lines", "price_avg", "qty_avg", "total"])
    v = per_feature(df, spec, {"value": lambda c: F.corr(c, F.col("label").cast("double"))})
    return rnd(e.ranked_features(v, 4), G)


@query(
    "mean_abs_top",
    f"WITH {OM}, z AS (SELECT "
    + ", ".join(f"avg(abs({f} - m_{f})) AS {f}" for f in ("lines", "qty_avg", "tax_avg"))
    + " FROM om, (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}" for f in ("lines", "qty_avg", "tax_avg"))
    + f" FROM om)) SELECT feature, {r('v')} AS mean_abs FROM z UNPIVOT (v FOR feature IN (lines, qty_avg, tax_avg)) ORDER BY v DESC LIMIT 2",
)
def mean_abs_top(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    feats = ["lines", "qty_avg", "tax_avg"]
    mu = df.agg(*[F.avg(f).alias(f) for f in feats]).head()
    c = df.select("case_id", *[(F.col(f) - F.lit(mu[f])).alias(f) for f in feats])
    return rnd(e.mean_abs_top(c, feats, 2), G)
