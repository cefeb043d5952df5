"""The extraction table's rules, and result texts."""

import math

from casebook.operators import firstorder, survival

LONG = "case_id string, feature string, value double"
QUALITY = "case_id string, name string, value double"


def test_cases_that_cannot_be_used_have_a_reason(spark):
    rows = []
    for case in ("a", "b", "c", "d", "e", "f"):
        rows += [(case, "t1_mean", 1.0), (case, "t1.max", 2.0), (case, "diagnostics_version", 9.0)]
    rows = [r for r in rows if r[:2] != ("b", "t1.max")]
    rows += [("c", "t1_mean", 5.0), ("d", "unknown", 3.0), (None, "t1_mean", 1.0), ("a", None, 1.0)]
    quality = [(c, "noise", 0.5) for c in "abcdef"]
    labels = [("a", 1), ("b", 0), ("c", 1), ("d", 0), ("e", None), ("f", 1), ("f", 1), ("z", 1)]
    made = spark.createDataFrame(rows, LONG), spark.createDataFrame(quality, QUALITY), spark.createDataFrame(labels, "case_id string, label int")
    good, errors = firstorder.extraction_table(*made)
    assert good.columns == ["case_id", "label", "Quality_noise", "t1.max", "t1_mean"]
    assert sorted(map(tuple, good.collect())) == [("a", 1, 0.5, 2.0, 1.0), ("d", 0, 0.5, 2.0, 1.0)]
    assert {r.case_id: r.reason for r in errors.collect()} == {
        "b": "missing features", "c": "repeated features", "e": "no label", "f": "several labels"
    }


def test_columns_are_those_of_the_first_case_or_given(spark):
    df = spark.createDataFrame([("b", "x", 1.0), ("b", "y", 2.0), ("a", "x", None), ("b", "diagnostics", 0.0)], LONG)
    good, errors = firstorder.extraction_table(df)
    assert good.columns == ["case_id", "x"] and good.count() == 2 and errors.count() == 0  # a null value is a value
    good, errors = firstorder.extraction_table(df, columns=["y", "x"], ignore=None)
    assert [tuple(r) for r in good.collect()] == [("b", 1.0, 2.0)] and errors.head().case_id == "a"
    good, errors = firstorder.extraction_table(df.limit(0))
    assert good.columns == ["case_id"] and good.count() == 0 and errors.count() == 0


def test_survival_texts(spark):
    nan = math.nan
    rows = [(1, 0.0625, 0.12345, 0.5, 0.75), (2, nan, None, 0.1, nan), (3, -0.0001, 1.0, None, 2.0), (4, 0.9996, 0.0, -0.5, 0.5)]
    df = spark.createDataFrame(rows, "g int, mean double, std double, ci_low double, ci_high double")
    got = {r.g: (r.mean, r.std, r.ci) for r in survival.metric_texts(df, ["g"]).collect()}
    assert got == {
        1: ("0.062", "0.123", "0.500-0.750"),
        2: ("N/A", "N/A", "N/A"),
        3: ("0.000", "1.000", "N/A"),
        4: ("1.000", "0.000", "-0.500-0.500"),
    }
