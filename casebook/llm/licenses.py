"""Licence scans with a positional index of rare licence words.

Every template is a licence phrase or key passage, word by word. Inverse document frequencies come from
the scanned table itself. A file is looked up by its rarest licence words only; their places, less the
places of the same words in a template, say where the template would have to begin, and each such
alignment is verified word by word. A label needs one of its template's mandatory phrases in full.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import whole_text

@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    base: bool = False


#: Phrases that are evidence of a licence on their own.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
TEMPLATES = (
    *BASE,
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("apache-2", "licensed under the apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsd", "under the bsd license"),
    Template("gpl", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "creative commons zero"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
)
RAREST = 2
#: Outside of words in a text in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    ``lower`` also changes other letters; the Kelvin sign, the only one that it would turn into a
    single ASCII letter, is set aside first.
    """
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, GAP), "")


def rarity(files: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """Inverse document frequency, over all rows of ``files.words``, of every word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.phrase.split()})
    own = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    seen = files.select(F.explode(own).alias("word")).groupBy("word").count()
    total = files.count()
    found = {r["word"]: r["count"] for r in seen.collect()}  # at most a row a word of the templates
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def anchors(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The template's rarest words, each with its place in the phrase; the earlier word wins a tie."""
    places = {}
    for i, word in enumerate(template.phrase.split()):
        places.setdefault(word, i)
    return sorted(places.items(), key=lambda x: (-idf[x[0]], x[1]))[:RAREST]


def _starts(template: Template, rare: list[tuple[str, int]]) -> Column:
    """Where the template's phrase stands: the anchors' places agree and all its words are there."""
    phrase = template.phrase.split()
    def begins(word: str, place: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - place)

    by_anchor = [begins(word, place) for word, place in rare]
    aligned = reduce(F.array_intersect, by_anchor) if len(by_anchor) > 1 else F.array_distinct(by_anchor[0])
    whole = F.array(*[F.lit(w) for w in phrase])
    return F.filter(aligned, lambda s: (s >= 0) & (F.slice("words", s + 1, len(phrase)) == whole))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Licence evidence of every row of ``docs``.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start; null without any), base_labels and labels (distinct, sorted, joined by commas;
    empty without any) and score: 0 without a phrase, and nearer to 1 by half with every place.
    Null texts count as empty. Repeated rows and null ids get a row each. An empty table gives no row.
    Other columns are ignored, whatever their names.
    """
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(whole_text()).alias("words"))
    idf = rarity(files, templates)
    rare = {t: anchors(t, idf) for t in templates}
    indexed = sorted({word for own in rare.values() for word, _ in own})
    numbered = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    found = files.select("doc_id", "words", F.filter(numbered, lambda h: h["word"].isin(indexed)).alias("hits"))
    starts = [_starts(t, rare[t]).alias(f"t{i}") for i, t in enumerate(templates)]
    placed = found.select("doc_id", F.size("words").cast("long").alias("n_words"), *starts)

    def labels(chosen: list[int]) -> Column:
        names = F.array(*[F.when(F.size(f"t{i}") > 0, F.lit(templates[i].label)) for i in chosen])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ",")

    base = [i for i, t in enumerate(templates) if t.base]
    every = list(range(len(templates)))
    places = F.concat(*[F.col(f"t{i}") for i in base])
    total = reduce(lambda a, b: a + b, [F.size(f"t{i}") for i in every])
    return placed.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(every).alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(0.5), total)).alias("score"),
    )


def oracle_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """The same by comparing every phrase at every word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    columns = []
    for i, t in enumerate(templates):
        phrase = t.phrase.split()
        listed = ", ".join(f"'{w}'" for w in phrase)
        columns.append(f"[s FOR s IN range(len(w)) IF w[s + 1 : s + {len(phrase)}] = [{listed}]] AS t{i}")

    def labels(chosen: list[int]) -> str:
        names = ", ".join(f"CASE WHEN len(t{i}) > 0 THEN '{templates[i].label}' END" for i in chosen)
        return f"coalesce(array_to_string(list_sort(list_distinct([x FOR x IN [{names}] IF x IS NOT NULL])), ','), '')"

    base = [i for i, t in enumerate(templates) if t.base]
    every = list(range(len(templates)))
    total = " + ".join(f"len(t{i})" for i in every)
    places = "flatten([" + ", ".join(f"t{i}" for i in base) + "])"
    return (
        f"WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w FROM documents), "
        f"p AS (SELECT doc_id, len(w)::BIGINT AS n_words, {', '.join(columns)} FROM f) "
        f"SELECT doc_id, n_words, len({places})::BIGINT AS n_base, list_min({places})::BIGINT AS first_word, "
        f"list_max({places})::BIGINT AS last_word, {labels(base)} AS base_labels, {labels(every)} AS labels, "
        f"1.0::DOUBLE - pow(0.5::DOUBLE, {total}) AS score FROM p"
    )
