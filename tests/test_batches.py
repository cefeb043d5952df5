"""Models fitted together against numpy, against each other and against enumeration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import batch_linear, batch_networks, batch_trees, models, select
from casebook.operators.blocks import ALL, MAIN, Block, packed, table_blocks, wide_table
from casebook.functions.exprs import col
from casebook.plans.exploration import Choices, explore
from tests.util import matrix


def parted(spark, n=240, p=4, seed=3, signal=0.7):
    """A matrix whose case i lies in fold i mod 3, or in part -1 for the last third."""
    df, spec, pdf = matrix(spark, n=n, p=p, seed=seed, signal=signal)
    pdf["part"] = [-1 if i >= 2 * n // 3 else i % 3 for i in range(n)]
    df = spark.createDataFrame(pdf).repartition(5)
    return packed(wide_table(df, spec, {f: col(f) for f in spec.features}, F.col("part")), rows=17), spec, pdf


def rows_of(pdf, rows):
    return pdf[pdf.part == -1] if rows == MAIN else pdf[(pdf.part >= 0) & (pdf.part != rows)]


def design(pdf, names):
    return np.c_[pdf[list(names)].to_numpy(), np.ones(len(pdf))], np.where(pdf.label == 1, 1.0, -1.0)


def test_linear_models_are_stationary_on_their_rows(spark):
    data, spec, pdf = parted(spark)
    tasks = []
    for rows in (MAIN, ALL, 0, 1, 2):
        for cols in ((0,), (0, 2), (0, 1, 2, 3)):
            tasks += [batch_linear.Task(cols, rows, tol=1e-9), batch_linear.Task(cols, rows, l1=2.0, tol=1e-9)]
    for cells in (10**9, 30):  # all at once, and a few models a job
        fits = batch_linear.solve(data, tasks, cells)
        for t, f in zip(tasks, fits):
            x, y = design(rows_of(pdf, t.rows), [spec.features[i] for i in t.columns])
            w = np.r_[f.coef, f.intercept]
            slope = -(x * (y / (1 + np.exp(y * (x @ w))))[:, None]).sum(axis=0)
            pull = np.where(w == 0, np.maximum(np.abs(slope) - t.l1, 0), np.abs(slope + t.l1 * np.sign(w)))
            pull[-1] = abs(slope[-1])
            assert f.converged and pull.max() < 1e-5
    data.release()


def test_hinge_objective_is_near_its_least(spark):
    data, spec, pdf = parted(spark)
    (fit,) = batch_linear.solve(data, [batch_linear.Task((0, 1, 2, 3), ALL, hinge=True, l2=1.0, tol=1e-4)])
    x, y = design(rows_of(pdf, ALL), spec.features)
    value = lambda w: np.maximum(1 - y * (x @ w), 0).sum() + 0.5 * (w[:-1] ** 2).sum()
    w = np.r_[fit.coef, fit.intercept]
    rng = np.random.default_rng(0)
    least, step = value(w), 0.05
    for _ in range(4000):  # a random descent finds nothing notably lower
        trial = w + rng.normal(size=len(w)) * step
        least, w, step = (value(trial), trial, step * 1.1) if value(trial) < least else (least, w, max(step * 0.99, 1e-6))
    assert value(np.r_[fit.coef, fit.intercept]) <= least + 0.025 * len(x) * 0.05


class _Copies:
    """Sums over ``times`` copies of cases whose columns are divided by their length over all copies."""

    def __init__(self, x, y, times):
        x = x / np.sqrt(times * (x * x).sum(axis=0))
        self.block = Block(x, y, np.full(len(y), MAIN, np.int32), np.arange(len(y)))
        self.times, self.jobs = times, 0

    def sums(self, task):
        self.jobs += 1
        return {i: self.times * cell for i, cell in task(iter([self.block])).items()}


def test_jobs_do_not_grow_with_copies_of_the_cases():
    rng = np.random.default_rng(4)
    x = rng.random((500, 6)) * [1, 5, 50, 0.1, 1000, 8]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(0, 0.5, 500) > 1).astype(float)
    jobs, orders = [], []
    for times in (1, 100, 100_000):
        blocks = _Copies(x, y, times)
        (fit,) = batch_linear.solve(blocks, [batch_linear.Task(tuple(range(6)), MAIN, hinge=True, l2=1.0, tol=1e-3, max_iter=100)])
        assert fit.converged
        jobs.append(blocks.jobs)
        orders.append(np.argsort(np.square(fit.coef)).tolist())
    assert max(jobs) <= min(jobs) + 2, jobs
    assert orders[0] == orders[1] == orders[2]


def test_halvings_of_a_step_are_tried_together():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, 400) > 0).astype(float)
    blocks = _Copies(x, y, 1)
    points = np.array([[0.0, 1.0], [0.0, -2.0], [0.0, 0.5], [0.0, 0.1]])
    task = batch_linear.Task((0, 1, 2), MAIN, hinge=True, l2=1.0)
    several = batch_linear._evaluate(blocks, [(0, task, points, 0.5)])[0]
    single = [batch_linear._evaluate(blocks, [(0, task, p, 0.5)])[0] for p in points.T]
    assert several.tolist() == pytest.approx([400.0, single[0][1], single[1][1]])


def test_separable_and_constant_columns_end(spark):
    df, spec, pdf = matrix(spark, n=60, p=2)
    pdf["f0"], pdf["f1"] = np.where(pdf.label == 1, 1.0, -1.0), 3.0
    df = spark.createDataFrame(pdf)
    for name in ("logistic", "lasso_logistic", "linear_svm"):
        m = getattr(models, name)(df, spec)
        assert np.isfinite([*m.coef, m.intercept, m.scale, m.shift]).all() and m.coef[0] > 0
    with pytest.raises(Exception, match="null or infinite"):
        models.logistic(df.withColumn("f1", F.lit(None).cast("double")), spec)


def best_split(x, y, w, criterion):
    """(impurity, column, threshold) by enumeration."""
    def cost(mask):
        total = w[mask].sum()
        if total == 0:
            return 0.0
        p = np.array([(w * y)[mask].sum(), (w * (1 - y))[mask].sum()]) / total
        return total * (1 - (p**2).sum() if criterion == "gini" else -(p[p > 0] * np.log2(p[p > 0])).sum())
    found = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        for t in (v[1:] + v[:-1]) / 2:
            found.append((cost(x[:, j] <= t) + cost(x[:, j] > t), j, t))
    return min(found, key=lambda f: (round(f[0], 9), f[1], f[2]))


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_root_split_and_stump_equal_enumeration(spark, criterion):
    data, spec, pdf = parted(spark)
    bins = batch_trees.binned(data)
    own = rows_of(pdf, 1)
    x, y = own[list(spec.features)].to_numpy(), own.label.to_numpy()
    _, j, t = best_split(x, y, np.ones(len(y)), criterion)
    for subtree in (100_000, 0):  # grown in one task, and level by level
        (tree,) = batch_trees.trees(bins, [batch_trees.TreeTask((0, 1, 2, 3), 1, criterion=criterion, depth=1)], subtree)
        threshold = bins.cuts[j][tree.bin[0]]
        assert tree.column[0] == j and np.array_equal(x[:, j] <= threshold, x[:, j] <= t)
    (rules,) = batch_trees.boosted(bins, [batch_trees.TreeTask((0, 1, 2, 3), 1)], [3])
    w = np.ones(len(y))
    for column, b, low, alpha in rules:
        _, j, t = best_split(x, y, w, "gini")
        assert column == j and np.array_equal(x[:, j] <= bins.cuts[j][b], x[:, j] <= t)
        wrong = np.where(x[:, j] <= t, low, -low) != np.where(y == 1, 1, -1)
        error = w[wrong].sum() / w.sum()
        assert alpha == pytest.approx(np.log((1 - error) / error))
        w = w * np.exp(alpha * wrong)


def test_trees_grown_by_level_and_at_once_agree(spark):
    data, _, _ = parted(spark)
    bins = batch_trees.binned(data)
    tasks = [batch_trees.TreeTask((0, 1, 2), rows, seed, True, 2) for rows in (MAIN, 0) for seed in range(3)]
    tasks.append(batch_trees.TreeTask((0, 1, 2, 3), ALL))
    whole = batch_trees.trees(bins, tasks)
    for subtree in (0, 20):
        assert batch_trees.trees(bins, tasks, subtree, together=2) == whole
    leaf = [s for c, s in zip(whole[-1].column, whole[-1].share) if c < 0]
    assert set(leaf) <= {0.0, 1.0}  # grown until pure


def test_cuts_hold_all_values_or_quantiles(spark):
    data, spec, pdf = parted(spark)
    cuts = batch_trees.column_cuts(data)
    v = np.unique(pdf.f0)
    assert np.allclose(cuts[0], (v[1:] + v[:-1]) / 2)
    few = batch_trees.column_cuts(data, bins=8)[0]
    share = np.searchsorted(np.sort(pdf.f0.to_numpy()), few) / len(pdf)
    assert len(few) == 7 and np.abs(share - np.arange(1, 8) / 8).max() < 0.1


def test_moments_of_folds_equal_single_fits(spark):
    data, spec, pdf = parted(spark)
    got = models.block_moments(data, [MAIN, ALL, 2])
    for rows, m in got.items():
        one = models.class_moments(spark.createDataFrame(rows_of(pdf, rows)), spec)
        assert m.n == one.n and np.allclose(m.pooled, one.pooled) and np.allclose(m.var, one.var) and np.allclose(m.overall, one.overall)


def test_batch_equals_one_by_one(spark):
    """The exploration's rows are those of models fitted one after the other on the same tables."""
    df, spec, pdf = matrix(spark, n=120, p=4, signal=1.2)
    names = ("LR", "LRLasso", "SVM", "LDA", "NB", "RF", "DT", "AB")
    c = Choices(balance="None", normalizers=("Zscore", "MinMax"), selectors=("RFE",), numbers=(2,), classifiers=names, folds=3)
    out = explore(df, spec, c)
    preds = out.predictions.filter("split = 'train'").toPandas()
    from casebook.operators import normalize

    for norm in c.normalizers:
        state = out.prepared[norm, "PCC", "RFE", 2, "LR"]
        scaled = normalize.apply_normalizer(df, spec, state["normalizer"])
        for name in names:
            own = out.prepared[norm, "PCC", "RFE", 2, name]
            single = models.CLASSIFIERS[name](scaled, spec.only(own["features"]))
            a = single.predict(scaled).toPandas().set_index("case_id").pred.sort_index()
            b = preds[(preds.normalizer == norm) & (preds.classifier == name)].set_index("case_id").pred.sort_index()
            assert np.allclose(a, b, atol=1e-6), (norm, name)


def test_nested_elimination_equals_single_runs(spark):
    df, spec, _ = matrix(spark, n=100, p=5)
    nested = select.rfe_subsets(df, spec, [1, 2, 4, 5])
    for k in (1, 2, 4):
        assert nested[k] == [r["feature"] for r in select.rfe_ranks(df, spec, k) if r["rank"] == 1]
    assert nested[5] == list(spec.features)


def test_grid_search_in_batches(spark):
    df, spec, _ = matrix(spark, n=90, p=3)
    for name in ("DT", "SVM", "AB"):
        model, rows = models.grid_search(df, spec, name, folds=3)
        assert len(rows) == len(models.grid_points(models.GRIDS[name])) and all(0.3 < r["accuracy"] <= 1 for r in rows)
    cv = models.cross_predict(df, spec, "LR", folds=3).toPandas()
    assert cv.case_id.is_unique and len(cv) == 90


@pytest.mark.parametrize("hidden", [(), (7,), (5, 3)])
def test_network_slope_equals_differences(hidden):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 4)), (rng.random(40) < 0.4).astype(float)
    task = batch_networks.NetTask((0, 1, 2, 3), ALL, hidden)
    w = task.start()
    value = lambda w: batch_networks.loss_and_gradient(w, task.sizes, x, y, 0.3)
    _, slope = value(w)
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        assert slope[i] == pytest.approx((value(w + e)[0] - value(w - e)[0]) / 2e-6, abs=1e-6)


def test_network_without_hidden_layer_is_logistic_regression(spark):
    data, spec, pdf = parted(spark)
    for rows in (MAIN,):
        net = batch_networks.NetTask((0, 1, 2), rows, (), alpha=0.0, rate=0.05, epochs=250, tol=0.0, patience=250)
        (fit,) = batch_networks.train(data, [net])
        (best,) = batch_linear.solve(data, [batch_linear.Task((0, 1, 2), rows, tol=1e-9)])
        assert np.allclose(fit.weights, [*best.coef, best.intercept], atol=0.02)
    data.release()


def test_networks_in_one_job_or_several_and_over_tasks(spark):
    data, spec, pdf = parted(spark)
    nets = [batch_networks.NetTask((0, 1), rows, (h,), epochs=4) for rows in (MAIN, ALL, 2) for h in (3, 8)]
    together = batch_networks.train(data, nets)
    assert batch_networks.train(data, nets, cells=1) == together  # one network a job
    spread = packed(data.wide.repartition(6, "_key"), rows=17)
    many = type(spread)(spread.columns, spread.wide, spread.data.repartition(6), 6)
    net = batch_networks.NetTask((0, 1, 2, 3), ALL, (8,), rate=0.01, epochs=40)
    (one,), (six,) = batch_networks.train(data, [net]), batch_networks.train(many, [net])
    assert six.loss == pytest.approx(one.loss, abs=0.03) and len(six.weights) == net.width
    data.release(), spread.release()


def test_network_learns_what_no_line_separates(spark):
    df, spec, pdf = matrix(spark, n=600, p=2, seed=5)
    pdf["label"] = ((pdf.f0 > 0) ^ (pdf.f1 > 0)).astype(int)
    df = spark.createDataFrame(pdf)
    net = models.perceptron(df, spec, hidden=(30,), rate=0.01)
    right = lambda m: ((m.predict(df).toPandas().pred > 0.5).astype(int).to_numpy() == pdf.label.to_numpy()).mean()
    assert right(net) > 0.93 > 0.7 > right(models.logistic(df, spec))
    again = models.perceptron(df.repartition(3), spec, hidden=(30,), rate=0.01)
    assert np.allclose(net.chance(pdf[["f0", "f1"]].to_numpy()), again.chance(pdf[["f0", "f1"]].to_numpy()), atol=1e-6)
    with pytest.raises(Exception, match="null or infinite"):
        models.perceptron(df.withColumn("f1", F.lit(None).cast("double")), spec, hidden=(3,))


def test_network_options_are_searched_together(spark):
    df, spec, _ = matrix(spark, n=90, p=3, signal=2.0)
    model, rows = models.grid_search(df, spec, "AE", [{"hidden": [(4,), (8,)], "alpha": [1e-4, 1e-2], "rate": [0.001, 0.02]}], folds=3)
    assert len(rows) == 8 and max(r["accuracy"] for r in rows) > 0.6 and model.sizes[0] == 3
    assert len(models.grid_points(models.GRIDS["AE"])) == 8


def test_subtrees_stay_out_of_the_driver(spark):
    """A forest names the places of its subtrees; its scores are those of the trees fetched whole."""
    data, spec, pdf = parted(spark, n=600)
    bins = batch_trees.binned(data)
    tasks = [batch_trees.TreeTask((0, 1, 2, 3), ALL, seed, True, 2) for seed in range(3)]
    x = pdf[list(spec.features)].to_numpy()
    for subtree in (100_000, 60):
        folder, stored = batch_trees.stored_trees(bins, tasks, subtree)
        whole = batch_trees.trees(bins, tasks, subtree)
        assert all(len(t.column) < len(w.column) / 2 and t.parts for t, w in zip(stored, whole))
        fields = tuple((t.column, t.bin, t.left, t.right, t.cut, t.share, t.parts) for t in stored)
        got = models.ForestScore("RF", spec.features, folder, fields).chance(x)
        want = np.zeros(len(x))
        for t in whole:
            for i, case in enumerate(x):
                at = 0
                while t.column[at] >= 0:
                    at = t.left[at] if case[t.column[at]] <= bins.cuts[t.column[at]][t.bin[at]] else t.right[at]
                want[i] += t.share[at] / len(whole)
        assert np.allclose(got, want)


def test_equal_cases_grow_as_one(spark):
    """Copies of a table give its tree, from as many rows as differ."""
    data, _, pdf = parted(spark)
    x = np.repeat(np.arange(12, dtype=np.uint16).reshape(-1, 1), 2, axis=1)
    y = np.arange(12) % 3 == 0
    task = batch_trees.TreeTask((0, 1), ALL)
    one = batch_trees.grown(x, y.astype(float), np.full(12, 5.0), task)
    many = batch_trees.grown(np.tile(x, (5, 1)), np.tile(y, 5).astype(float), np.ones(60), task)
    assert one.tobytes() == many.tobytes()
    copies = spark.createDataFrame(pdf).crossJoin(spark.range(4)).withColumn("case_id", F.concat("case_id", F.lit("-"), F.col("id"))).drop("id")
    spec = matrix(spark, n=2, p=4)[1]
    plain, fourfold = (packed(wide_table(d, spec, {f: col(f) for f in spec.features}, F.col("part"))) for d in (spark.createDataFrame(pdf), copies))
    (a,), (b,) = (batch_trees.trees(batch_trees.binned(d), [batch_trees.TreeTask((0, 1, 2, 3), ALL)], 50) for d in (plain, fourfold))
    assert a == b


def test_a_node_without_a_split_in_its_first_columns_looks_at_later_ones(spark):
    df, spec, pdf = matrix(spark, n=90, p=4)
    pdf[["f0", "f1", "f2"]] = 1.0
    data = table_blocks(spark.createDataFrame(pdf), spec)
    bins = batch_trees.binned(data)
    tasks = [batch_trees.TreeTask((0, 1, 2, 3), ALL, seed, True, 1) for seed in range(4)]
    assert batch_trees.trees(bins, tasks, 0) == batch_trees.trees(bins, tasks)


def test_jobs_of_the_solvers_do_not_carry_the_preparation(spark, monkeypatch):
    from casebook.operators import blocks

    df, spec, _ = matrix(spark, n=120, p=3)
    names = {f"m{i}": F.col("case_id") for i in range(20)}
    df = df.join(df.select("case_id", *[c.alias(n) for n, c in names.items()]).hint("merge"), "case_id")  # some preparation
    plans, packed_ = [], blocks.packed

    def spied(wide, *a, **kw):
        out = packed_(wide, *a, **kw)
        plans.append(out.data._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(blocks, "packed", spied)
    out = explore(df, spec, Choices(normalizers=("Zscore",), selectors=("ANOVA",), numbers=(1,), classifiers=("LDA",), folds=2))
    assert out.metrics.count() == 3
    for plan in plans:
        assert "Join" not in plan and "Window" not in plan and "ExistingRDD" in plan


@pytest.mark.parametrize("tried, criterion", [(2, "gini"), (None, "entropy"), (1, "gini")])
def test_a_subtree_grows_level_by_level(monkeypatch, tried, criterion):
    """Few steps however many nodes there are, and every node is split where its own cases alone say."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (900, 5)).astype(np.uint16)
    y, w = (rng.random(900) < 0.5).astype(float), rng.poisson(1, 900).astype(float)
    task = batch_trees.TreeTask(tuple(range(5)), ALL, 3, True, tried, 30, criterion)
    calls, splits = [], batch_trees._splits
    monkeypatch.setattr(batch_trees, "_splits", lambda *a: calls.append(1) or splits(*a))
    nodes = batch_trees.grown(x, y, w, task, 5, 2)
    assert len(nodes) > 200 and len(calls) <= 5 * 30
    open_ = [(0, 5, np.flatnonzero(w > 0))]
    while open_:
        k, name, rows = open_.pop()
        ones, all_ = (np.zeros((5, 9)) for _ in range(2))
        for j in range(5):
            np.add.at(ones[j], x[rows, j], w[rows] * y[rows])
            np.add.at(all_[j], x[rows, j], w[rows])
        best = None
        if 0 < ones[0].sum() < all_[0].sum():
            best = batch_trees._choose(task.order(name), tried, lambda j: batch_trees._best_of(ones[j], all_[j], criterion))
        node = nodes[k]
        if best is None:
            assert node["column"] == -1 and node["share"] == ones[0].sum() / all_[0].sum()
            continue
        assert (node["column"], node["bin"]) == best
        low = x[rows, best[0]] <= best[1]
        open_ += [(int(node["left"]), 2 * name, rows[low]), (int(node["right"]), 2 * name + 1, rows[~low])]
