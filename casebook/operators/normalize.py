"""Feature scaling as fitted state: one aggregate to fit, one projection to apply.

State has a row per feature: feature, slope, intercept. The fitted projection has no
aggregate, so it runs on batch and streaming tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import MAX_DOUBLE, col, literal_rows
from casebook.operators.stats import per_feature
from casebook.spec import MatrixSpec


def _none(c):
    return {"intercept": F.lit(0.0), "spread": F.lit(1.0)}


def _minmax(c):
    return {"intercept": F.min(c), "spread": F.max(c) - F.min(c)}


def _zscore(c):
    return {"intercept": F.avg(c), "spread": F.stddev_pop(c)}


def _mean(c):
    return {"intercept": F.avg(c), "spread": F.max(c) - F.min(c)}


NORMALIZERS = {"None": _none, "MinMax": _minmax, "Zscore": _zscore, "Mean": _mean}


def fit_normalizer(df: DataFrame, spec: MatrixSpec, method="Zscore") -> list[dict]:
    """``slope`` is the divisor and ``intercept`` the value mapped to zero; one row per feature."""
    maker = NORMALIZERS[method] if isinstance(method, str) else method
    if maker is _none:
        return [{"feature": f, "slope": 1.0, "intercept": 0.0} for f in spec.features]
    state = per_feature(
        df, spec, {k: (lambda c, k=k: maker(c.cast("double"))[k]) for k in ("intercept", "spread")}
    )
    by = {r.feature: r for r in state.collect()}
    return [
        {"feature": f, "slope": float(by[f].spread), "intercept": float(by[f].intercept)} for f in spec.features
    ]


def scaled(x: Column, slope: float, intercept: float) -> Column:
    """(x - intercept) / slope; 0/0 becomes 0 and overflow the largest double."""
    if slope == 0:
        d = x - intercept
        return F.when(d > 0, MAX_DOUBLE).when(d < 0, -MAX_DOUBLE).otherwise(0.0)
    v = (x - intercept) / slope
    return (
        F.when(v.isNull() | F.isnan(v), 0.0)
        .when(v > MAX_DOUBLE, MAX_DOUBLE)
        .when(v < -MAX_DOUBLE, -MAX_DOUBLE)
        .otherwise(v)
    )


def apply_normalizer(df: DataFrame, spec: MatrixSpec, state: list[dict]) -> DataFrame:
    by = {r["feature"]: r for r in state}
    missing = [f for f in spec.features if f not in by]
    if missing:
        raise ValueError(f"the normaliser was not fitted on {missing}")
    new = {f: scaled(col(f).cast("double"), by[f]["slope"], by[f]["intercept"]) for f in spec.features}
    return df.withColumns(new)


def state_table(spark, state: list[dict]) -> DataFrame:
    return spark.range(1).select(F.inline(literal_rows(state)))


def l2_norms(df: DataFrame, spec: MatrixSpec) -> dict[str, float]:
    """Length of every feature column; zero columns count as one."""
    row = df.agg(*[F.sqrt(F.sum(col(f).cast("double") * col(f))).alias(f) for f in spec.features]).head()
    return {f: row[f] if row[f] else 1.0 for f in spec.features}


def apply_l2(df: DataFrame, spec: MatrixSpec, norms: dict[str, float]) -> DataFrame:
    return df.withColumns({f: col(f).cast("double") / F.lit(norms[f]) for f in spec.features})
