"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's distinct words and their beginnings. Next to a weight, every term has a short vector;
the product of two vectors is what the pair adds, so that an insult next to a mention of a group can
count for more than both alone, or less.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import held_out, in_slices, record, whole_text

TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000  # labelled rows that the model is fitted on, at most
TERMS = 4_096  # hashed terms in the model, at most: those with most evidence
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
#: Evidence (see ``evidence``) that a term, or two terms that stand together, say more than the model knows.
ALONE, TOGETHER = 10.0, 20.0
PASSES = 4  # of choosing terms, at most
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")


def hashed_terms(word: str) -> set[int]:
    """Buckets of a word and of its beginnings."""
    terms = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
    return {zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms}


@dataclass
class Machine:
    """``buckets`` sorted; one weight and one vector for each."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    @classmethod
    def fit(cls, buckets: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray, factors: int = 4, rounds: int = 400, seed: int = 11) -> Machine:
        """Logistic loss by full-batch Adam; ``rows`` hold positions in ``buckets``."""
        x = np.zeros((len(rows), len(buckets)), np.float32)
        for i, row in enumerate(rows):
            x[i, row] = 1
        y = toxic.astype(np.float32)
        each = np.where(y == 1, (1 - y).sum() ** 0.5, y.sum() ** 0.5).astype(np.float32)  # the rarer class counts by the root of the odds
        each /= each.sum()
        rng = np.random.default_rng(seed)
        theta = [np.zeros(1, np.float32), np.zeros(len(buckets), np.float32), rng.normal(0, 0.02, (len(buckets), factors)).astype(np.float32)]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, rounds + 1):
            bias, w, v = theta
            sums = x @ v
            z = bias + x @ w + 0.5 * ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1))
            error = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            pull = x.T @ error
            slopes = [error.sum(keepdims=True), pull + 2e-5 * w, x.T @ (error[:, None] * sums) - pull[:, None] * v + 2e-4 * v]
            for i, slope in enumerate(slopes):
                first[i] += 0.1 * (slope - first[i])
                second[i] += 0.001 * (slope**2 - second[i])
                theta[i] = theta[i] - 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return cls(buckets, float(theta[0][0]), theta[1], theta[2])

    def score(self, row: np.ndarray) -> float:
        """Probability of the label for a text whose terms stand at these positions."""
        v = self.vectors[row]
        z = self.bias + self.weights[row].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Scorer:
    """Scores texts; what a word stands for is remembered, up to ``most`` words."""

    def __init__(self, machine: Machine, most: int = 150_000):
        self.machine, self.most = machine, most
        self.place = {int(b): i for i, b in enumerate(machine.buckets)}
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, text: str) -> np.ndarray:
        words = set(LETTERS.findall(text.lower()))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, list(words)
        for word in new:
            self.known[word] = tuple(self.place[b] for b in hashed_terms(word) if b in self.place)
        return np.array(sorted({p for w in words for p in self.known[w]}), np.int64)

    def __call__(self, text: str) -> float:
        return self.machine.score(self.places(text))


def evidence(rows: np.ndarray, toxic: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Chernoff bound, as -log of a chance, on ``toxic`` of ``rows`` rows being toxic where ``expected`` were."""
    n = np.maximum(rows, 1)
    seen, p = np.clip(toxic / n, 0, 1), np.clip(expected / n, 1e-6, 1 - 1e-6)
    return rows * (seen * np.log(np.maximum(seen, 1e-12) / p) + (1 - seen) * np.log(np.maximum(1 - seen, 1e-12) / (1 - p)))


class Sample:
    """Labelled rows by term: what each term, and each two terms, tell beyond a model's expectation."""

    def __init__(self, buckets: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray):
        self.buckets, self.rows, self.toxic = buckets, rows, toxic.astype(np.float32)
        places = np.concatenate(rows)
        self.counts = np.bincount(places, minlength=len(buckets))
        self.ends = np.concatenate(([0], np.cumsum(self.counts)))
        self.own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[np.argsort(places, kind="stable")]

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64)[self.own], self.ends[:-1])

    def rows_of(self, term: int) -> np.ndarray:
        return self.own[self.ends[term] : self.ends[term + 1]]

    def alone(self, expected: np.ndarray) -> np.ndarray:
        return evidence(self.counts, self.by_term(self.toxic), self.by_term(expected))

    def together(self, expected: np.ndarray, block: int = 1_024) -> np.ndarray:
        """The most evidence of each term's pairs, where that is ``TOGETHER`` or more, else 0.

        No set of a term's rows holds more evidence than its toxic rows, or its clean ones, alone, so a term
        below that bound is in no such pair. Terms of the same rows are compared once.
        """
        bound = np.maximum(self.by_term(-self.toxic * np.log(expected)), self.by_term((self.toxic - 1) * np.log(1 - expected)))
        distinct = {self.rows_of(j).tobytes(): j for j in np.flatnonzero(bound >= TOGETHER)[::-1]}
        able, most = np.array(sorted(distinct.values()), np.int64), np.zeros(len(self.counts))
        weights = [w[:, None].astype(np.float32) for w in (np.ones(len(expected)), self.toxic, expected)]

        def dense(terms: np.ndarray) -> np.ndarray:
            x = np.zeros((len(self.rows), len(terms)), np.float32)
            for i, term in enumerate(terms):
                x[self.rows_of(term), i] = 1
            return x

        for i in range(0, len(able), block):
            left = able[i : i + block]
            x = dense(left)
            for k in range(i, len(able), block):
                right = able[k : k + block]
                other = dense(right)
                found = evidence(*(x.T @ (other * w) for w in weights))
                found[left[:, None] == right[None, :]] = 0
                most[left], most[right] = np.maximum(most[left], found.max(axis=1)), np.maximum(most[right], found.max(axis=0))
        return np.where(most >= TOGETHER, most, 0)

    def fitted(self, chosen: np.ndarray) -> tuple[Machine, np.ndarray]:
        """A machine of the chosen terms, and what it expects of every row."""
        place = np.full(len(self.buckets), -1)
        place[chosen] = np.arange(len(chosen))
        rows = [place[r][place[r] >= 0] for r in self.rows]
        machine = Machine.fit(self.buckets[chosen], rows, self.toxic)
        score = np.clip([machine.score(r) for r in rows], 1e-6, 1 - 1e-6)
        odds = score / (1 - score) * (self.toxic.sum() / (1 - self.toxic).sum()) ** 0.5  # without the weight of the rarer class
        return machine, np.clip(odds / (1 + odds), 1e-4, 1 - 1e-4)


def chosen_machine(sample: Sample, terms: int = TERMS) -> Machine:
    """Fit, and take up all terms that alone or in pairs tell what the fit does not, until there are none.

    A term needs no effect of its own: its pairs are tried next to what the model knows. How often it must
    be there follows from how much its rows surprise the model.
    """
    expected = np.full(len(sample.rows), sample.toxic.mean(), np.float64)
    strength = np.zeros(len(sample.counts))
    machine = None
    for step in range(PASSES):
        alone = sample.alone(expected)
        found = np.where(alone >= ALONE, alone, 0)
        if machine is not None:  # pairs next to a fit of the terms that tell something alone
            found = np.maximum(found, sample.together(expected))
        if machine is not None and not ((found > 0) & (strength == 0)).any():
            break
        strength = np.where(strength > 0, strength, found)
        chosen = np.sort(np.argsort(-strength, kind="stable")[: min(terms, (strength > 0).sum())])
        machine, expected = sample.fitted(chosen)
    return machine


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, terms: int = TERMS) -> Machine:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled documents that are not held out, picked by hash.

    A document with several labels is toxic if one of them says so; null labels and ids are ignored. If
    a class is missing, every score is the share of the other: 0 without toxic rows, 1 without clean ones.
    A term of a single row, or of all rows, tells nothing that the row or the bias does not.
    """
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = [
        own.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for toxic, most in ((1, toxic_rows), (0, clean_rows))
    ]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most toxic_rows + clean_rows rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(sample, "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("one")  # however many rows share an id
    texts = texts.groupBy("doc_id").agg(one).select("one.toxic", "one.text")
    schema = pa.schema([("toxic", pa.int32()), ("terms", pa.list_(pa.int32()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own_texts in in_slices(batches):
            found = [sorted(set().union(*map(hashed_terms, set(LETTERS.findall(t.lower()))))) for t in own_texts]
            yield record(schema, rows.column("toxic"), found)

    rows = texts.mapInArrow(hashed, "toxic int, terms array<int>").persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not (bad and good):
            return Machine(np.zeros(0, np.int64), 30.0 if bad else -30.0, np.zeros(0), np.zeros((0, 1)))
        counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        buckets = np.sort(counts.filter(F.col("n").between(2, bad + good - 1)).select("term").toArrow().column("term").to_numpy())
        shared = np.full(BUCKETS, -1, np.int32)
        shared[buckets] = np.arange(len(buckets))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                found = [shared[np.array(t, np.int64)] for t in part.column("terms").to_pylist()]
                yield record(schema, part.column("toxic"), [t[t >= 0] for t in found])

        small = rows.mapInArrow(placed, "toxic int, terms array<int>").toArrow()
    finally:
        rows.unpersist()
    toxic, places = small.column("toxic").to_numpy(), [t.values.to_numpy() for t in small.column("terms")]
    if not len(buckets):
        return Machine.fit(buckets, places, toxic)
    return chosen_machine(Sample(buckets, places, toxic), terms)


def scored(machine: Machine, spark, text: Column) -> Column:
    """The score of a text column, null counting as empty."""
    sent = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(sent.value)
        for texts in batches:
            yield pd.Series([own(t) for t in texts], dtype="float64")

    return score(whole_text(text))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null texts count as empty; texts without a term of the model get the score of none. Repeated rows
    and null ids get a row each (a null id is not held out). An empty table gives no row. Other columns
    are ignored, whatever their names.
    """
    machine = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(machine, docs.sparkSession, F.col("text")).alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
