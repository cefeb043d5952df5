"""SQL text of the derived matrices, mirroring ``casebook.sources.tables``."""

from __future__ import annotations

from casebook.sources.tables import DOC_FEATURES, ORDER_FEATURES, ORDER_MEASURES


def snap(expr: str, digits: int = 4) -> str:
    k = f"1e{digits}::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {k} + 0.5::DOUBLE) / {k})"


def r(expr: str, digits: int = 8) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def _line_aggs() -> str:
    parts = ["count(*)::DOUBLE AS lines"]
    for short, c in ORDER_MEASURES.items():
        parts += [
            f"{snap(f'avg({c})')} AS {short}_avg",
            f"max({c}) AS {short}_max",
            f"{snap(f'stddev_pop({c})')} AS {short}_std",
            f"{snap(f'sum({c})')} AS {short}_sum",
        ]
    parts.append("max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label")
    return ", ".join(parts)


_FEATS = ", ".join(ORDER_FEATURES)

# CTE bodies; use as f"WITH {OM} SELECT ... FROM om"
OM = (
    f"om AS (SELECT o_orderkey::VARCHAR AS case_id, label, {_FEATS} FROM "
    f"(SELECT l_orderkey, {_line_aggs()} FROM lineitem GROUP BY l_orderkey) l "
    "JOIN (SELECT o_orderkey, o_totalprice AS total FROM orders) o ON l_orderkey = o_orderkey)"
)
OS = (
    f"os AS (SELECT o_orderkey::VARCHAR AS case_id, label AS event, "
    f"(1 + abs(date_diff('day', odate, ship)))::DOUBLE AS duration, {_FEATS} FROM "
    f"(SELECT l_orderkey, {_line_aggs()}, max(l_shipdate::DATE) AS ship FROM lineitem GROUP BY l_orderkey) l "
    "JOIN (SELECT o_orderkey, o_totalprice AS total, o_orderdate::DATE AS odate FROM orders) o "
    "ON l_orderkey = o_orderkey)"
)


def _without(cls: str) -> str:
    return f"length(regexp_replace(text, '{cls}', '', 'g'))"


_SIZE = "greatest(length(text), 1)::DOUBLE"
DM = (
    "dm AS (SELECT d.doc_id::VARCHAR AS case_id, l.quality::INT AS label, "
    f"{snap('(length(text) - ' + _without('[0-9]') + ') / ' + _SIZE)} AS digit_share, "
    f"{snap('len(list_distinct(string_split(text, chr(32))))::DOUBLE / len(string_split(text, chr(32)))')}"
    " AS distinct_share, "
    "(length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS lines, n_chars::DOUBLE AS n_chars, "
    f"{snap('(length(text) - ' + _without('[.,;:!?]') + ') / ' + _SIZE)} AS punct_share, "
    f"{snap('(length(text) - ' + _without('[A-Z]') + ') / ' + _SIZE)} AS upper_share, "
    "len(string_split(text, chr(32)))::DOUBLE AS words, d.lang, d.source, l.toxic::INT AS toxic "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
EM = (
    "em AS (SELECT vec_id::VARCHAR AS case_id, (label < 5)::INT AS label, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i:02d}" for i in range(64))
    + " FROM embeddings)"
)
PR = (
    "pr AS (SELECT o_orderpriority AS model, o_orderstatus AS split, o_orderkey::VARCHAR AS case_id, pred, label "
    f"FROM orders JOIN (SELECT l_orderkey, {snap('10 * avg(l_discount)', 2)} AS pred, "
    "max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY l_orderkey) l "
    "ON o_orderkey = l_orderkey)"
)
PP = (
    f"pp AS (SELECT l_orderkey::VARCHAR AS case_id, {snap('10 * avg(l_discount)', 2)} AS pred_a, "
    f"{snap('avg(l_tax) / 0.08::DOUBLE', 2)} AS pred_b, "
    "max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY l_orderkey)"
)
RT = (
    "rt AS (SELECT l_returnflag AS normalizer, l_linestatus AS selector, l_linenumber::INT AS n_features, "
    "'c' || (round(l_tax * 100)::INT)::VARCHAR AS classifier, "
    f"{snap('avg(l_discount * 10)', 6)} AS auc, {snap('stddev_pop(l_discount * 10)', 6)} / 10 AS std "
    "FROM lineitem GROUP BY 1, 2, 3, 4)"
)
ME = "me AS (SELECT user_id::VARCHAR AS case_id, event_type AS series, value FROM events)"


def _rater(odd: int) -> str:
    return (
        f"(SELECT l_partkey::VARCHAR AS case_id, {snap('avg(l_discount)')} AS disc, "
        f"{snap('avg(l_extendedprice)')} AS price, {snap('avg(l_quantity)')} AS qty "
        f"FROM lineitem WHERE l_linenumber % 2 = {odd} GROUP BY 1)"
    )


RA = f"ra AS {_rater(1)}, rb AS {_rater(0)}"
_K = "case_id::BIGINT"
DIRTY = (
    f"{OM}, dirty AS (SELECT case_id, label::VARCHAR AS label, '7' AS constant, "
    f"CASE WHEN {_K} % 97 = 0 THEN '' WHEN {_K} % 101 = 0 THEN 'abc' ELSE qty_sum::VARCHAR END AS a_qty, "
    f"CASE WHEN {_K} % 103 = 0 THEN 'NaN' ELSE disc_avg::VARCHAR END AS b_disc, "
    f"CASE WHEN {_K} % 107 = 0 THEN 'inf' ELSE tax_avg::VARCHAR END AS c_tax, "
    f"CASE WHEN {_K} % 20 = 0 THEN lines::VARCHAR ELSE '3.0' END AS mostly, lines::VARCHAR AS lines FROM om)"
)


def unpivoted(cte: str, features, keys="case_id, label") -> str:
    """CTE body of the long form: ``<cte>_long(keys, feature, value)``."""
    cols = ", ".join(features)
    return (
        f"{cte}_long AS (SELECT {keys}, feature, value FROM "
        f"(SELECT {keys}, {cols} FROM {cte}) UNPIVOT (value FOR feature IN ({cols})))"
    )


OML = unpivoted("om", ORDER_FEATURES)
OSL = unpivoted("os", ORDER_FEATURES, "case_id, event, duration")
DML = unpivoted("dm", DOC_FEATURES)


_WEIGHT = "(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def normal_p(z: str) -> str:
    """Two-sided normal tail: one less the density from -z to z by Simpson's rule."""
    inside = f"list_sum([{_WEIGHT} * exp(-pow(i * abs({z}) / 1000, 2) / 2) FOR i IN range(0, 1001)])"
    return f"(1 - sqrt(2 / pi()) * {inside} * abs({z}) / 3000)"


def t_p(t: str, v: str) -> str:
    """Two-sided tail of Student's t: one less the density from -t to t by Simpson's rule."""
    inside = f"list_sum([{_WEIGHT} * pow(1 + pow(i * abs({t}) / 1000, 2) / ({v}), -(({v}) + 1) / 2) FOR i IN range(0, 1001)])"
    height = f"exp(lgamma((({v}) + 1) / 2) - lgamma(({v}) / 2)) / sqrt(({v}) * pi())"
    return f"(1 - 2 * {height} * {inside} * abs({t}) / 3000)"
