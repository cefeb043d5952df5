"""Joining, stacking and comparing matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.operators.cleaning import prefixed
from casebook.spec import MatrixSpec


def key_difference(left: DataFrame, right: DataFrame, key="case_id") -> DataFrame:
    """Keys found on one side only: key, side."""
    lk, rk = left.select(key), right.select(key)
    return (
        lk.join(rk, key, "left_anti")
        .withColumn("side", F.lit("left"))
        .unionByName(rk.join(lk, key, "left_anti").withColumn("side", F.lit("right")))
    )


def column_difference(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = set(left.columns), set(right.columns)
    return {"left": sorted(a - b), "right": sorted(b - a)}


def same_keys(left: DataFrame, right: DataFrame, key="case_id") -> bool:
    return key_difference(left, right, key).limit(1).count() == 0


def same_features(left: MatrixSpec, right: MatrixSpec) -> bool:
    return sorted(left.features) == sorted(right.features)


def merge_features(left, left_spec: MatrixSpec, right, right_spec: MatrixSpec, prefixes=None, check=True):
    """Columns of two tables over the same cases, one row each; the left label stays."""
    if prefixes:
        left, left_spec = prefixed(left, left_spec, prefixes[0])
        right, right_spec = prefixed(right, right_spec, prefixes[1])
    clash = set(left_spec.features) & set(right_spec.features)
    if clash:
        raise ValueError(f"both tables have the features {sorted(clash)}")
    if check and not same_keys(left, right, left_spec.case_id):
        raise ValueError("the tables do not hold the same cases")
    spec = left_spec.only(sorted([*left_spec.features, *right_spec.features]))
    return spec.project(left.join(right.select(right_spec.case_id, *right_spec.features), left_spec.case_id)), spec


def merge_cases(top: DataFrame, bottom: DataFrame, spec: MatrixSpec, check=True) -> DataFrame:
    """Rows of two tables with the same columns and different cases."""
    diff = column_difference(top, bottom)
    if diff["left"] or diff["right"]:
        raise ValueError(f"columns differ: {diff}")
    if check and top.select(spec.case_id).join(bottom.select(spec.case_id), spec.case_id, "left_semi").limit(1).count():
        raise ValueError("some cases are in both tables")
    return top.unionByName(bottom)


def attach_clinical(df: DataFrame, clinical: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Left join of a side table; a label column on the right is ignored."""
    drop = [c for c in clinical.columns if c.lower() == "label"]
    return df.join(clinical.drop(*drop), spec.case_id, "left")


def split_by_reference(df: DataFrame, reference: DataFrame, spec: MatrixSpec, check=True):
    """(train, test): cases named by the reference are the test set."""
    ids = reference.select(spec.case_id).distinct()
    if check and ids.join(df.select(spec.case_id), spec.case_id, "left_anti").limit(1).count():
        raise ValueError("the reference names cases that are not in the matrix")
    return df.join(ids, spec.case_id, "left_anti"), df.join(ids, spec.case_id, "left_semi")


def restrict_curves(train: DataFrame, test: DataFrame | None, cases: DataFrame, key="case_id", check=True) -> DataFrame:
    """Curves of the named cases, from the training and test curves together."""
    both = train if test is None else train.unionByName(test)
    ids = cases.select(key).distinct()
    if check and ids.join(both.select(key), key, "left_anti").limit(1).count():
        raise ValueError("some named cases have no curve")
    return both.join(ids, key, "left_semi")
