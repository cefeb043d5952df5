"""Holdouts and folds.

Random orders come from hashes of the case id and a seed, so a split does not
depend on how the data is partitioned. Positions within a class are found with
bucketed numbering: a class is never ordered on one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.exprs import col, hashed
from casebook.operators.prefix import numbered, shuffled_order
from casebook.session import kept
from casebook.spec import MatrixSpec

#: Standard deviations around its expected place in which the boundary of a random holdout is looked for.
SPREAD = 7.0


def _positioned(df: DataFrame, group: list[str], spec: MatrixSpec, seed: int | None) -> DataFrame:
    """``row_no`` within ``group``: by hash for a seed, by case id without one."""
    if seed is None:
        return numbered(df, group, spec.case_id)
    h = df.withColumn("_hash", hashed(seed, spec.case_id))
    return shuffled_order(h, group, "_hash", spec.case_id).drop("_hash")


def stratified_holdout(df: DataFrame, spec: MatrixSpec, fraction=0.3, seed: int | None = 0) -> DataFrame:
    """Add ``side``: of every class, half-even rounded ``n * fraction`` cases go to test."""
    pos = _positioned(df, [spec.label], spec, seed)
    test = F.col("row_no") <= F.bround(F.col("group_n") * F.lit(float(fraction)))
    return pos.withColumn("side", F.when(test, "test").otherwise("train")).drop("row_no", "group_n")


def _fold_plan(df: DataFrame, spec: MatrixSpec, k: int) -> dict:
    """Class -> cumulative fold sizes. Classes in order of first appearance are laid end to
    end; a fold takes from a class as many cases as that segment has positions ≡ fold (mod k)."""
    classes = (
        df.groupBy(spec.label)
        .agg(F.count(F.lit(1)).alias("n"), F.min(spec.case_id).alias("first"))
        .orderBy("first")
        .collect()
    )
    plan, start = {}, 0
    for c in classes:
        ends, total = [], 0
        for f in range(k):
            first = start + (f - start) % k
            total += max(0, -(-(start + c.n - first) // k))
            ends.append(total)
        plan[c[spec.label]] = ends
        start += c.n
    return plan


def stratified_folds(df: DataFrame, spec: MatrixSpec, k: int, out="fold") -> DataFrame:
    """Fold number 0..k-1; within a class, cases fill the folds in case order.

    A class of fewer than k cases is missing from some folds; only if all classes are that small is it an error.
    """
    plan = _fold_plan(df, spec, k)
    if plan and all(ends[-1] < k for ends in plan.values()):
        raise ValueError(f"no class has {k} cases")
    pos = _positioned(df, [spec.label], spec, None)
    fold = F.lit(None).cast("int")
    for value, ends in plan.items():
        bound = F.array(*[F.lit(e) for e in ends])
        mine = F.size(F.filter(bound, lambda e: e < F.col("row_no")))
        fold = F.when(col(spec.label).eqNullSafe(F.lit(value)), mine).otherwise(fold)
    return pos.withColumn(out, fold).drop("row_no", "group_n")


def leave_one_out(df: DataFrame, spec: MatrixSpec, out="fold") -> DataFrame:
    """A fold per case, in case order, whatever their number. Fitting a model for each fold is the caller's cost."""
    return numbered(df, [], spec.case_id, out="_no").withColumn(out, (F.col("_no") - 1).cast("int")).drop(
        "_no", "group_n"
    )


def survival_folds(df: DataFrame, spec: MatrixSpec, k: int, seed: int | None = 0, out="fold") -> DataFrame:
    """Folds 1..k dealt in turn over the cases in random order, events last."""
    pos = _positioned(df, [spec.label], spec, seed)
    first = df.filter(col(spec.label) == 0).count()
    start = F.when(col(spec.label) == 0, 0).otherwise(first)
    return pos.withColumn(out, ((start + F.col("row_no") - 1) % k + 1).cast("int")).drop("row_no", "group_n")


def _hash_at(share: float) -> int:
    """The 64-bit hash below which about ``share`` of all hashes lie."""
    return max(-(2**63), min(2**63 - 1, int(share * 2**64) - 2**63))


def seeded_sides(df: DataFrame, spec: MatrixSpec, fraction: float, seeds: list[int]) -> DataFrame:
    """(seed, case_id, side) for many candidate holdouts at once.

    The boundary of each (seed, class) is the hash of its last test case. Hashes are uniform, so it lies near the same
    place of the hash range for every seed: cases below a narrow range around that place are counted, and only those
    inside are ordered. Seeds with a boundary outside (ids that repeat a lot) are done by counts per hash prefix.
    """
    base = kept(df.select(spec.case_id, spec.label))
    keys = ["seed", spec.label]

    def drawn(some: list[int]) -> DataFrame:
        rows = base.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in some])))
        return rows.withColumn("_h", F.xxhash64(spec.case_id, "seed"))

    sizes = base.filter(col(spec.label).isNotNull()).groupBy(spec.label).agg(F.count(F.lit(1)).alias("n"))
    classes = sizes.withColumn("want", F.bround(F.col("n") * F.lit(float(fraction)))).filter("want > 0").collect()
    low = high = want = F.lit(None)
    for c in classes:
        share, mine = min(c.want / c.n, 1.0), col(spec.label) == F.lit(c[spec.label])
        slack = SPREAD * math.sqrt(share * (1 - share) / c.n) + SPREAD**2 / c.n
        low = F.when(mine, F.lit(_hash_at(share - slack))).otherwise(low)
        high = F.when(mine, F.lit(_hash_at(share + slack))).otherwise(high)
        want = F.when(mine, F.lit(int(c.want))).otherwise(want)
    expanded = drawn(seeds)
    h = F.col("_h")
    below = expanded.groupBy(*keys).agg(F.count_if(h < low).alias("_below")).select(*keys, (want - F.col("_below")).alias("_place"))
    inside = expanded.filter((h >= low) & (h <= high)).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", spec.case_id))
    )
    found = inside.join(F.broadcast(below), keys).filter(F.col("_r") == F.col("_place"))  # one row per (seed, class)
    edge = kept(found.select(*keys, F.struct("_h", spec.case_id).alias("_edge")))
    seen = {r.seed for r in edge.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(classes)).collect()}
    missed = [s for s in seeds if s not in seen] if classes else []
    if missed:
        edge = edge.filter(~F.col("seed").isin(missed)).unionByName(_edges_by_prefix(drawn(missed), keys, spec, fraction))
    marked = expanded.join(F.broadcast(edge), keys, "left")  # one row per (seed, class)
    side = F.when(F.struct("_h", spec.case_id) <= F.col("_edge"), "test").otherwise("train")
    return marked.select("seed", spec.case_id, side.alias("side"))


def _edges_by_prefix(expanded: DataFrame, keys: list[str], spec: MatrixSpec, fraction: float, bits=12) -> DataFrame:
    """The boundary of each (seed, class) from counts per hash prefix; only the cases that share its prefix are ordered."""
    expanded = expanded.withColumn("_p", F.shiftright("_h", 64 - bits))
    counts = expanded.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("_p")
    whole = Window.partitionBy(*keys)
    at = counts.select(
        *keys,
        "_p",
        "n",
        (F.sum("n").over(w) - F.col("n")).alias("before"),
        F.bround(F.sum("n").over(whole) * F.lit(float(fraction))).alias("want"),
    ).filter((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n")))
    # At most one prefix per (seed, class): the side with a row per seed and case never moves for it.
    inside = expanded.join(F.broadcast(at), [*keys, "_p"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", spec.case_id))
    )
    edge = inside.filter(F.col("_r") == F.col("want") - F.col("before"))
    return edge.select(*keys, F.struct("_h", spec.case_id).alias("_edge"))
