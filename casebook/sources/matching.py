"""Assigning one file to every (case, series) by name rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import col


@dataclass(frozen=True)
class NameRule:
    """A name qualifies if it ends with the suffix, holds every include key and no exclude key."""

    series: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    suffix: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def matches(self, name: Column) -> Column:
        hit = F.lit(True)
        if self.suffix:
            hit = hit & name.endswith(self.suffix)
        for key in self.include:
            hit = hit & name.contains(key)
        for key in self.exclude:
            hit = hit & ~name.contains(key)
        return hit


def match_names(df: DataFrame, case: str, name: str, path: str, rules: list[NameRule]) -> DataFrame:
    """Long match table: case, series, path (when unique), n_candidates, error.

    All rules are evaluated in the same pass; the aggregate keeps a count and one
    path per rule, never the candidate list.
    """
    if len({r.series for r in rules}) != len(rules):
        raise ValueError("series names must be distinct")
    aggs = []
    for i, rule in enumerate(rules):
        hit = rule.matches(col(name))
        aggs += [F.count_if(hit).alias(f"_n{i}"), F.min(F.when(hit, col(path))).alias(f"_p{i}")]
    wide = df.groupBy(col(case).alias("case")).agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(rule.series).alias("series"),
                F.col(f"_n{i}").alias("n_candidates"),
                F.when(F.col(f"_n{i}") == 1, F.col(f"_p{i}")).alias("path"),
                F.when(F.col(f"_n{i}") != 1, F.lit("Can not match")).alias("error"),
            )
            for i, rule in enumerate(rules)
        ]
    )
    return wide.select("case", F.explode(cells).alias("c")).select("case", "c.*")


def wide_matches(matches: DataFrame, rules: list[NameRule]) -> DataFrame:
    return matches.groupBy("case").pivot("series", [r.series for r in rules]).agg(F.first("path", True))


def all_matched(matches: DataFrame) -> bool:
    """True when there is at least one cell and none is in error."""
    row = matches.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).head()
    return row.n > 0 and row.bad == 0


def file_names(spark, root: str, pattern: str | None = None) -> DataFrame:
    """Files below ``root`` as case (parent folder), name and path; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    parts = F.split("path", "/")
    return reader.load(root).select(
        "path", F.element_at(parts, -2).alias("case"), F.element_at(parts, -1).alias("name")
    )
