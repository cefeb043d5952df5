import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.operators import cleaning, merging
from casebook.sources import matching, matrix_io
from casebook.spec import MatrixSpec
from tests.util import matrix


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_csv_in_both_encodings(spark, tmp_path, encoding):
    path = str(tmp_path / f"{encoding}.csv")
    with open(path, "w", encoding=encoding) as f:
        f.write("CaseID,label,b,a\n病例一,1,2.5,1\n病例二,0,3.5,2\n")
    df, spec = matrix_io.case_matrix(matrix_io.read_frame(spark, path))
    assert spec.features == ("a", "b")
    assert [tuple(r) for r in df.orderBy("label").collect()] == [("病例二", 0, 2.0, 3.5), ("病例一", 1, 1.0, 2.5)]


def test_label_rules(spark):
    raw = spark.createDataFrame([("x", 1.0)], "id string, f double")
    with pytest.raises(ValueError):
        matrix_io.case_matrix(raw)
    df, _ = matrix_io.case_matrix(raw, emulate_label=True)
    assert df.head().label == 0


def test_survival_columns_are_checked(spark):
    raw = spark.createDataFrame([("x", 1, 2.0, 0.1), ("y", 2, 3.0, 0.2), ("z", 3, 1.0, 0.3)], "id string, e int, d double, f double")
    with pytest.raises(ValueError):
        matrix_io.survival_matrix(raw, "e", "missing")
    with pytest.raises(ValueError):
        matrix_io.survival_matrix(raw, "e", "d")
    with pytest.raises(ValueError):
        matrix_io.survival_matrix(raw.filter("e = 1"), "e", "d")
    df, _ = matrix_io.survival_matrix(raw.filter("e < 3"), "e", "d")
    assert sorted(r.event for r in df.collect()) == [0, 1]


def test_content_keys_are_unique_for_copies(spark):
    raw = spark.createDataFrame([(1, None)] * 5 + [(2, "a")] * 3 + [(3, "b")], "x int, y string")
    keyed = matrix_io.keyed_by_content(raw).toPandas()
    assert len(keyed) == 9 and keyed.case_id.is_unique
    assert set(keyed.case_id) == set(matrix_io.keyed_by_content(raw.repartition(5)).toPandas().case_id)


def test_save_and_append(spark, tmp_path):
    df, spec, pdf = matrix(spark, n=30)
    matrix_io.save_matrix(df, spec, str(tmp_path / "m.parquet"))
    back = spark.read.parquet(str(tmp_path / "m.parquet"))
    assert back.columns == ["case_id", "label", "f0", "f1", "f2"] and back.count() == 30
    matrix_io.save_matrix(df, spec, str(tmp_path / "csv"), fmt="csv")
    again, _ = matrix_io.case_matrix(matrix_io.read_frame(spark, str(tmp_path / "csv")), "case_id", "label")
    assert again.count() == 30
    row = spark.createDataFrame([("train", 0.5)], "split string, auc double")
    matrix_io.append_results(row, str(tmp_path / "res"))
    matrix_io.append_results(row, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2
    matrix_io.save_state(row, str(tmp_path / "state"))
    assert matrix_io.load_state(spark, str(tmp_path / "state")).head().auc == 0.5


def test_matching_files(spark, tmp_path):
    for case, names in {"p1": ["t1_ax.nii", "t2_ax.nii"], "p2": ["t1_a.nii", "t1_b.nii", "t2.txt"]}.items():
        (tmp_path / case).mkdir()
        for n in names:
            (tmp_path / case / n).write_text("x")
    files = matching.file_names(spark, str(tmp_path))
    rules = [matching.NameRule("T1", include=("t1",), suffix=".nii"), matching.NameRule("T2", include=("t2",), exclude=("txt",))]
    m = matching.match_names(files, "case", "name", "path", rules)
    got = {(r.case, r.series): (r.n_candidates, r.error) for r in m.collect()}
    assert got[("p1", "T1")] == (1, None) and got[("p2", "T1")] == (2, "Can not match") and got[("p2", "T2")][0] == 0
    assert not matching.all_matched(m) and matching.all_matched(m.filter("case = 'p1'"))
    assert matching.wide_matches(m, rules).filter("case = 'p1'").head().T1.endswith("p1/t1_ax.nii")


def test_merges_refuse_bad_input(spark):
    df, spec, _ = matrix(spark, n=20)
    with pytest.raises(ValueError):
        merging.merge_features(df, spec, df, spec)
    with pytest.raises(ValueError):
        merging.merge_features(df, spec, df.limit(5), spec, prefixes=("a", "b"))
    with pytest.raises(ValueError):
        merging.merge_cases(df, df, spec)
    with pytest.raises(ValueError):
        merging.split_by_reference(df, spark.createDataFrame([("nobody",)], "case_id string"), spec)
    out, merged = merging.merge_features(df, spec, df, spec, prefixes=("a", "b"))
    assert out.count() == 20 and len(merged.features) == 6
    assert merging.column_difference(df, df.drop("f0")) == {"left": ["f0"], "right": []}
    assert merging.same_features(spec, spec) and not merging.same_features(spec, spec.only(["f0"]))


def test_near_constant_share_is_exact(spark):
    n = 1000
    pdf = pd.DataFrame({"case_id": range(n), "label": 0, "at": [1.0] * 900 + list(range(100)), "below": [5.0] * 899 + list(range(10, 111))})
    df = spark.createDataFrame(pdf)
    spec = MatrixSpec(("at", "below"))
    assert cleaning.near_constant(df, spec) == ["at"]
    kept, left = cleaning.drop_near_constant(df, spec)
    assert left.features == ("below",) and kept.columns == ["case_id", "label", "below"]


def test_selection_errors_and_order(spark):
    df, spec, _ = matrix(spark, n=5)
    assert cleaning.select_by_index(df, spec, [2, 0])[1].features == ("f0", "f2")
    assert cleaning.select_by_index(df, spec, [2, 0], keep_order=True)[1].features == ("f2", "f0")
    with pytest.raises(ValueError):
        cleaning.select_by_name(df, spec, ["nope"])
    bad = df.withColumn("f1", F.lit("x"))
    assert cleaning.first_invalid_cell(bad, spec).head().feature == "f1"
    assert cleaning.first_invalid_cell(df, spec).count() == 0
    assert not cleaning.check_binary(df, spec).head().has_enough_cases


def test_lines_are_summed_by_order_in_tasks_of_bounded_size(spark, monkeypatch):
    from casebook.sources import tables

    def rows():
        return sorted(tables.orders_matrix(spark, "/root/testdata/sf0.001")[0].collect())

    plain = rows()
    lines = tables.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    monkeypatch.setattr(tables, "LINES_A_TASK", 100)
    df, _ = tables.orders_matrix(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and f", {-(-lines // 100)}" in plan
    assert rows() == plain


@pytest.mark.parametrize("name", ["orders_matrix", "orders_survival", "predictions"])
def test_orders_are_not_broadcast_however_small_their_file_looks(spark, name):
    from casebook.sources import tables

    made = getattr(tables, name)(spark, "/root/testdata/sf0.001")
    df = made if name == "predictions" else made[0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
