"""Statistical comparisons per feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.exprs import col, rounded
from casebook.operators import stats
from casebook.queries import query
from casebook.queries.sql import DM, DML, OM, OML, OS, RA, normal_p, r, t_p, unpivoted
from casebook.sources import kept_tables as t
from casebook.spec import MatrixSpec

# Rank table over om_long: n1/n0 per value, midranks and per-feature sums.
RANKS = f"""{OM}, {OML},
v AS (SELECT feature, value, count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1 FROM om_long GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) - n + (n + 1) / 2 AS mid FROM v),
s AS (SELECT feature, sum(n1) AS m, sum(n - n1) AS k, sum(n) AS t, sum(n1 * mid) AS r1, sum(n * n * n - n) AS ties FROM k GROUP BY 1)"""


@query(
    "mann_whitney",
    f"""WITH {RANKS}, u AS (SELECT *, r1 - m * (m + 1) / 2 AS u,
 sqrt(m * k / 12 * ((t + 1) - ties / (t * (t - 1)))) AS sd FROM s)
SELECT feature, {r('u', 2)} AS u, {r('(abs(u - m * k / 2) - 0.5) / sd')} AS z FROM u""",
)
def mann_whitney(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    res = stats.mann_whitney(stats.rank_sums(stats.two_side_counts(df, spec, F.col("label") == 1)))
    return res.select("feature", rounded("u", 2).alias("u"), rounded("z").alias("z"))


@query(
    "mann_whitney_p",
    f"""WITH {RANKS.replace(OM, DM).replace(OML, DML).replace("om_long", "dm_long")}, u AS (SELECT *, r1 - m * (m + 1) / 2 AS u,
 sqrt(m * k / 12 * ((t + 1) - ties / (t * (t - 1)))) AS sd FROM s), z AS (SELECT feature, u, (abs(u - m * k / 2) - 0.5) / sd AS z FROM u)
SELECT feature, {r('u', 2)} AS u, {r('z')} AS z, {r('least(1.0::DOUBLE, ' + normal_p('greatest(z, 0)') + ')', 6)} AS p FROM z""",
)
def mann_whitney_p(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    res = stats.mann_whitney(stats.rank_sums(stats.two_side_counts(df, spec, F.col("label") == 1)))
    return res.select("feature", rounded("u", 2).alias("u"), rounded("z").alias("z"), rounded("p_mw", 6).alias("p"))


@query(
    "chi_square",
    f"""WITH {DM}, u AS (
 SELECT label, 'lang' AS feature, lang AS value FROM dm UNION ALL SELECT label, 'source', source FROM dm UNION ALL
 SELECT label, 'toxic', toxic::VARCHAR FROM dm),
c AS (SELECT feature, value, count(*) FILTER (WHERE label = 1)::DOUBLE AS o1, count(*) FILTER (WHERE label = 0)::DOUBLE AS o0
 FROM u GROUP BY 1, 2),
m AS (SELECT *, sum(o1) OVER (PARTITION BY feature) AS t1, sum(o0) OVER (PARTITION BY feature) AS t0,
 count(*) OVER (PARTITION BY feature) - 1 AS dof FROM c),
e AS (SELECT *, (o1 + o0) * t1 / (t1 + t0) AS e1, (o1 + o0) * t0 / (t1 + t0) AS e0 FROM m),
g AS (SELECT *, abs(o1 - e1) - CASE WHEN dof = 1 THEN least(0.5, abs(o1 - e1)) ELSE 0 END AS gap FROM e)
SELECT feature, max(dof) AS dof, {r('sum(gap * gap / e1 + gap * gap / e0)')} AS chi2 FROM g GROUP BY 1""",
)
def chi_square(spark, sf):
    from casebook.operators.searches import text_codes

    df, spec = t.docs_matrix(spark, sf)
    side = t.docs_clinical(spark, sf)
    table = df.select("case_id", "label").join(text_codes(side, ["lang", "source"]), "case_id")
    spec = MatrixSpec(("lang", "source", "toxic"))
    counts = stats.two_side_counts(table, spec, F.col("label") == 1)
    res = stats.chi_square(stats.rank_sums(counts))
    return res.select("feature", "dof", rounded("chi2").alias("chi2"))


@query(
    "t_test",
    f"""WITH {OM}, {OML}, g AS (SELECT feature, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label = 0)::DOUBLE AS n0,
 avg(value) FILTER (WHERE label = 1) AS m1, avg(value) FILTER (WHERE label = 0) AS m0,
 var_pop(value) FILTER (WHERE label = 1) AS v1, var_pop(value) FILTER (WHERE label = 0) AS v0 FROM om_long GROUP BY 1)
SELECT feature, {r('(m1 - m0) / sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0))')} AS t FROM g""",
)
def t_test(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    return stats.t_test(df, spec, F.col("label") == 1).select("feature", rounded("t").alias("t"))


@query(
    "compare_two_tables",
    f"""WITH {OM}, om_s AS (SELECT *, (SELECT o_orderstatus FROM orders WHERE o_orderkey::VARCHAR = om.case_id) = 'P' AS side FROM om),
q AS (SELECT side, lines, qty_sum, disc_std FROM om_s),
u AS (SELECT side, feature, value FROM q UNPIVOT (value FOR feature IN (lines, qty_sum, disc_std))),
c AS (SELECT feature, value, count(*)::DOUBLE AS n, count(*) FILTER (WHERE side)::DOUBLE AS n1 FROM u GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) - n + (n + 1) / 2 AS mid,
 n * sum(n1) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS e1 FROM c),
s AS (SELECT feature, count(*) AS nv, sum(n1) AS m, sum(n1 * mid) AS r1,
 sum((n1 - e1) ** 2 / e1 + (n1 - e1) ** 2 / (n - e1)) AS chi2,
 string_agg(value::VARCHAR || ': ' || (n1::BIGINT)::VARCHAR, ', ' ORDER BY value) AS cat1,
 string_agg(value::VARCHAR || ': ' || ((n - n1)::BIGINT)::VARCHAR, ', ' ORDER BY value) AS cat0 FROM k GROUP BY 1),
g AS (SELECT feature, avg(value) FILTER (WHERE side) AS a1, stddev_pop(value) FILTER (WHERE side) AS s1,
 avg(value) FILTER (WHERE NOT side) AS a0, stddev_pop(value) FILTER (WHERE NOT side) AS s0 FROM u GROUP BY 1)
SELECT s.feature, CASE WHEN nv <= 9 THEN cat1 ELSE printf('%.2f+-%.2f', a1, s1) END AS test,
 CASE WHEN nv <= 9 THEN cat0 ELSE printf('%.2f+-%.2f', a0, s0) END AS train,
 CASE WHEN nv <= 9 THEN 'Chi-Square' ELSE 'Mann-Whitney' END AS method,
 {r('CASE WHEN nv <= 9 THEN chi2 ELSE r1 - m * (m + 1) / 2 END', 5)} AS statistic FROM s JOIN g ON s.feature = g.feature""",
)
def compare_two_tables(spark, sf):
    df, spec = t.orders_matrix(spark, sf)
    spec = spec.only(["disc_std", "lines", "qty_sum"])
    status = t.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), "o_orderstatus")
    out = stats.compare_features(df.join(status, "case_id"), spec, F.col("o_orderstatus") == "P", ("test", "train"))
    return out.select("feature", "test", "train", "method", rounded("statistic", 5).alias("statistic"))


_TEXT_P = "exp(-chi2 / 2) * (1 + chi2 / 2)"  # four degrees of freedom
_REGIONS = (
    "reg AS (SELECT o_orderkey, r_name AS region, o_orderpriority AS priority, c_mktsegment AS segment, o_orderstatus = 'F' AS side "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)


@query(
    "compare_text_features",
    f"""WITH {_REGIONS}, u AS (SELECT side, feature, value FROM (SELECT side, region, priority, segment FROM reg)
 UNPIVOT (value FOR feature IN (region, priority, segment))),
c AS (SELECT feature, value, count(*) FILTER (WHERE side)::DOUBLE AS n1, count(*) FILTER (WHERE NOT side)::DOUBLE AS n0 FROM u GROUP BY 1, 2),
e AS (SELECT *, (n1 + n0) * sum(n1) OVER w / (sum(n1) OVER w + sum(n0) OVER w) AS e1, (n1 + n0) * sum(n0) OVER w / (sum(n1) OVER w + sum(n0) OVER w) AS e0
 FROM c WINDOW w AS (PARTITION BY feature)),
g AS (SELECT feature, sum((n1 - e1) ** 2 / e1 + (n0 - e0) ** 2 / e0) AS chi2,
 string_agg(value || ': ' || (n1::BIGINT)::VARCHAR, ', ' ORDER BY value) AS finished,
 string_agg(value || ': ' || (n0::BIGINT)::VARCHAR, ', ' ORDER BY value) AS open FROM e GROUP BY 1)
SELECT feature, finished, open, {r(_TEXT_P)} AS p, 'Chi-Square' AS method, {r('chi2', 5)} AS statistic FROM g""",
)
def compare_text_features(spark, sf):
    """Text-typed features of finished and other orders: five values each, so four degrees of freedom."""
    orders, customer = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    place = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select(
        F.col("o_orderkey").cast("string").alias("case_id"),
        (F.col("o_orderstatus") == "F").alias("side"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
    )
    out = stats.compare_features(df, MatrixSpec(("priority", "region", "segment")), F.col("side"), ("finished", "open"))
    return out.select("feature", "finished", "open", rounded("p").alias("p"), "method", rounded("statistic", 5).alias("statistic"))


_K2 = """
SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
 (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM m"""


@query(
    "distribution_type",
    f"""WITH {DM}, {DML},
a AS (SELECT feature, count(*)::DOUBLE AS n, avg(value) AS mu, count(DISTINCT value) AS nd FROM dm_long GROUP BY 1),
m AS (SELECT l.feature, max(n) AS n, max(nd) AS nd, avg((value - mu) ** 3) / avg((value - mu) ** 2) ** 1.5 AS g,
 avg((value - mu) ** 4) / avg((value - mu) ** 2) ** 2 AS b FROM dm_long l JOIN a ON l.feature = a.feature GROUP BY 1),
p AS ({_K2}),
q AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS aa FROM p),
z AS (SELECT *, asinh(y / sqrt(2 / (w - 1))) / sqrt(ln(w) / 2) AS zs, 1 + x * sqrt(2 / (aa - 4)) AS d FROM q),
k AS (SELECT *, (1 - 2 / (9 * aa) - sign(d) * cbrt((1 - 2 / aa) / abs(d))) / sqrt(2 / (9 * aa)) AS zk FROM z)
SELECT feature, {r('zs * zs + zk * zk', 6)} AS k2, CASE WHEN nd < 10 THEN 'Category'
 WHEN exp(-(zs * zs + zk * zk) / 2) > 0.05 THEN 'Normal' ELSE 'Non-normal' END AS distribution FROM k""",
)
def distribution_type(spark, sf):
    df, spec = t.docs_matrix(spark, sf)
    return stats.distribution_type(df, spec).select("feature", rounded("k2", 6).alias("k2"), "distribution")


@query(
    "rater_agreement",
    f"""WITH {RA}, j AS (SELECT 'disc' AS feature, ra.disc AS a, rb.disc AS b FROM ra JOIN rb USING (case_id) UNION ALL
 SELECT 'price', ra.price, rb.price FROM ra JOIN rb USING (case_id) UNION ALL
 SELECT 'qty', ra.qty, rb.qty FROM ra JOIN rb USING (case_id)),
s AS (SELECT feature, count(*)::DOUBLE AS n, var_pop((a + b) / 2) AS v, avg((a - b) ** 2) AS g2, avg(a - b) AS g FROM j GROUP BY 1),
m AS (SELECT feature, n, 2 * n * v / (n - 1) AS msb, g2 / 2 AS msw, n * g * g / 2 AS msj, (n * g2 / 2 - n * g * g / 2) / (n - 1) AS mse FROM s)
SELECT feature, {r('(msb - msw) / (msb + msw)')} AS icc1, {r('(msb - mse) / (msb + mse + 2 * (msj - mse) / n)')} AS icc2,
 {r('(msb - mse) / (msb + mse)')} AS icc3 FROM m""",
)
def rater_agreement(spark, sf):
    a, b, spec = t.rater_pairs(spark, sf)
    out = stats.icc(a, b, spec)
    return out.select("feature", *[rounded(c).alias(c) for c in ("icc1", "icc2", "icc3")])


@query(
    "label_correlation",
    f"WITH {OM}, {OML} SELECT feature, {r('abs(corr(value, label))')} AS r FROM om_long GROUP BY 1",
)
def label_correlation(spark, sf):
    return stats.label_correlation(*t.orders_matrix(spark, sf)).select("feature", rounded("r").alias("r"))


@query(
    "tail_probabilities",
    f"""WITH {DM}, {DML}, g AS (SELECT feature, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label = 0)::DOUBLE AS n0,
 avg(value) FILTER (WHERE label = 1) AS m1, avg(value) FILTER (WHERE label = 0) AS m0,
 var_pop(value) FILTER (WHERE label = 1) AS v1, var_pop(value) FILTER (WHERE label = 0) AS v0 FROM dm_long GROUP BY 1),
t AS (SELECT feature, n1 + n0 - 2 AS v, abs(m1 - m0) / sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t FROM g)
SELECT feature, {r('t * t', 6)} AS f, {r(t_p('t', 'v'), 6)} AS p_f, {r(t_p('t', 'v'), 6)} AS p_t,
 {r(normal_p('t'), 6)} AS p_chi2, {r(normal_p('t'), 6)} AS p_normal FROM t""",
)
def tail_probabilities(spark, sf):
    """All four tails on the statistics of real features."""
    from casebook.functions import tails

    f = stats.anova_f(*t.docs_matrix(spark, sf))
    dof = F.col("n1") + F.col("n0") - 2
    tt = F.sqrt("f")
    return f.select(
        "feature",
        rounded("f", 6).alias("f"),
        rounded(tails.f_p(F.col("f"), F.lit(1.0), dof), 6).alias("p_f"),
        rounded(tails.t_p(tt, dof), 6).alias("p_t"),
        rounded(tails.chi2_p(F.col("f"), F.lit(1.0)), 6).alias("p_chi2"),
        rounded(tails.normal_two_sided_p(tt), 6).alias("p_normal"),
    )
