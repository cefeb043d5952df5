"""Language by rank-order profiles of letter n-grams.

A language's profile lists its most frequent n-grams (one to three letters of padded words). A document's
n-grams are ranked the same way, and the language with the smallest sum of rank differences is its own.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import held_out, in_slices, record, whole_text

PROFILE = 400  # n-grams of a language, and of a document, that are ranked
LONGEST = 3
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def grams(word: str) -> list[str]:
    """n-grams of a word between two marks of its ends."""
    padded = f"_{word}_"
    return [*word, *(padded[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(padded) - n + 1))]


def profiles(docs: DataFrame, size: int = PROFILE) -> pd.DataFrame:
    """lang, gram, rank: the ``size`` most frequent n-grams of each language, over all rows not held out.

    Rows without language or text are not learned from. Counts are summed in each task before they are
    shuffled; what comes back is ``size`` rows a language. Ties go to the smaller n-gram.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for rows, texts in in_slices(batches):
            for lang, text in zip(rows.column("lang").to_pylist(), texts):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 200_000:
                yield from sums(words)
                words = {}
        yield from sums(words)

    def sums(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            total: Counter = Counter()
            for word, n in own.items():
                for gram in grams(word):
                    total[gram] += n
            yield record(schema, [lang] * len(total), list(total), list(total.values()))

    rows = docs.filter("lang IS NOT NULL").filter(~held_out()).select("lang", whole_text().alias("text"))
    counts = rows.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank").toPandas()


def _code(gram: str) -> int:
    """A number that orders n-grams as text does."""
    return sum(ord(c) << 21 * (LONGEST - 1 - i) for i, c in enumerate(gram))


class Identifier:
    """Ranks all n-grams of a text, those of no profile included, and compares the ranks with each profile.

    n-grams are numbered as they are met, those of a profile first; words and numbers are forgotten when there are
    more than ``most``, which changes no result.
    """

    def __init__(self, table: pd.DataFrame, size: int = PROFILE, most: int = 300_000, most_grams: int = 60_000):
        self.size, self.most, self.most_grams = size, most, most_grams
        self.langs = sorted(table["lang"].unique())
        self.profiled = sorted(table["gram"].unique())
        self._forget()
        self.ranks = np.full((len(self.langs), len(self.profiled)), -1, np.int64)
        at = [self.langs.index(x) for x in table["lang"]], [self.place[g] for g in table["gram"]]
        self.ranks[at] = table["rank"].to_numpy()

    def _forget(self) -> None:
        self.place = {g: i for i, g in enumerate(self.profiled)}
        self.codes = np.array([_code(g) for g in self.profiled], np.int64)
        self.known: dict[str, bytes] = {}  # numbers of a word's n-grams, four bytes each

    def _numbered(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) + len(words) > self.most or len(self.place) > self.most_grams + len(self.profiled):
                self._forget()
                found = [None] * len(words)
            place, before = self.place, len(self.place)
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = self.known[word] = array("i", [place.setdefault(g, len(place)) for g in grams(word)]).tobytes()
            if len(place) > before:
                new = [_code(g) for g in islice(place, before, None)]
                self.codes = np.concatenate([self.codes, np.array(new, np.int64)])
        return found

    def _ranked(self, words: Counter) -> np.ndarray:
        """Numbers of the most frequent n-grams in order; ties go to the smaller n-gram."""
        cells = self._numbered(list(words))
        sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
        each = np.repeat(np.fromiter(words.values(), np.float64, len(words)), sizes)
        counts = np.bincount(np.frombuffer(b"".join(cells), np.int32), weights=each)
        present = np.flatnonzero(counts)
        n = counts[present]
        if len(n) > self.size:
            often = n >= np.partition(n, len(n) - self.size)[len(n) - self.size]
            present, n = present[often], n[often]
        return present[np.lexsort((self.codes[present], -n))[: self.size]]

    def __call__(self, text: str) -> tuple[str, float, float]:
        """(language, score, distance).

        The score is how much smaller the best distance is than the next, as a share of it; the distance is a share
        of the largest possible one, so 1 says that no n-gram of the text is in the profile.
        """
        words = Counter(LETTERS.findall(text.lower()))
        if not words or not self.langs:
            return UNDETERMINED, 0.0, 1.0
        top = self._ranked(words)
        at = np.flatnonzero(top < len(self.profiled))
        own = self.ranks[:, top[at]]
        # an n-gram that a profile lacks is as far out of place as can be
        apart = np.where(own < 0, self.size, np.abs(own - at)).sum(axis=1) + self.size * (len(top) - len(at))
        order = np.argsort(apart, kind="stable")
        best = int(apart[order[0]])
        share = best / (self.size * len(top))
        if len(order) == 1:
            return self.langs[order[0]], 1.0 - share, share
        following = int(apart[order[1]])
        return self.langs[order[0]], (following - best) / following if following else 0.0, share


def identified(table: pd.DataFrame, spark, text: Column) -> Column:
    """Struct (lang_pred, score, distance) of a text column, null counting as empty."""
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("lang_pred string, score double, distance double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Identifier(sent.value)
        for texts in batches:
            columns = {"lang_pred": "object", "score": "float64", "distance": "float64"}
            yield pd.DataFrame([own(t) for t in texts], columns=list(columns)).astype(columns)

    return identify(whole_text(text))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    ``und`` with score 0 if the text is null or has no letter, or nothing could be learned. Equal
    distances go to the language first in order, with score 0. Repeated rows and null ids get a row
    each (a null id is not held out). An empty table gives no row. Other columns are ignored, whatever
    their names.
    """
    found = identified(profiles(docs), docs.sparkSession, F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", held_out().alias("held_out"), "found.lang_pred", "found.score")
