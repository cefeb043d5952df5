"""Exact duplicates by content-defined chunk recipes.

A text without white space is cut where its own content says so. Every distinct chunk is moved once,
to verify that no two chunks share an identifier; documents are then compared by their ordered lists
of identifiers, eight bytes a chunk, and long texts move no more.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import one_of_each, row_key, whole_text, written

WHITE = r"[\x20\x09-\x0D]+"
SHORTEST, LONGEST = 512, 8192
#: A chunk ends behind the first of these pairs past the shortest length, or at the longest length.
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST - 2}}}?[aeiost0-5][dhlnr6-9.,]|.{{1,{LONGEST}}}"


def without_white(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def chunks(text: Column) -> Column:
    """The text as an array of chunks; empty for an empty text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column, draw: int) -> Column:
    """A 64-bit identifier; another ``draw`` gives unrelated ones."""
    return F.xxhash64(F.lit(draw), chunk)


def verified_draw(texts: DataFrame, identifier: Callable[[Column, int], Column] = chunk_id) -> int:
    """The first draw under which every identifier stands for one chunk of ``texts.clean``.

    Equal chunks are combined before they are shuffled, so a chunk in a third of all documents moves
    once a task. Draws fail with a probability near (chunks squared) / 2^65.
    """
    for draw in count():
        pieces = texts.select(F.explode(chunks(F.col("clean"))).alias("chunk"))
        distinct = pieces.select(identifier(F.col("chunk"), draw).alias("id"), "chunk").distinct()
        shared = distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
        if shared.agg(F.count("*")).first()[0] == 0:
            return draw


def exact_groups(docs: DataFrame, identifier: Callable[[Column, int], Column] = chunk_id) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal if they are the same without white space (``[\\x20\\x09-\\x0D]``); null counts as
    empty, and all empty texts are one group. The row with the most code points in its original text
    stays, of those the one with the smallest ``doc_id``; a null ``doc_id`` is smaller than any other.
    Rows that share ``doc_id``, length and clean text count as one document: they are kept or dropped
    together (``without_copies`` keeps one of them). An empty table gives no row. Other columns are
    ignored, whatever their names.
    """
    return _judged(docs, F.struct(F.col("doc_id").cast("long").alias("id")), identifier).drop("key")


def _judged(docs: DataFrame, key: Column, identifier: Callable[[Column, int], Column] = chunk_id) -> DataFrame:
    """``exact_groups`` with the rows' ``key``, a struct, whose order decides between equal lengths and ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("whole"), key.alias("key"))
    texts = texts.select("doc_id", F.length("whole").alias("size"), without_white(F.col("whole")).alias("clean"), "key")
    draw = verified_draw(texts, identifier)
    recipe = F.transform(chunks(F.col("clean")), lambda c: identifier(c, draw))
    recipes = written(
        texts.select("doc_id", "size", "key", recipe.alias("recipe"), F.sha2("clean", 256).alias("text_sha256")), "recipes"
    )
    best = F.min(F.struct((-F.col("size")).alias("size"), "doc_id", "key"))
    groups = recipes.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    # Written, so that the join has an exchange of its own on either side and a large group's rows can be split.
    groups = written(groups.select("recipe", "best", "group_size"), "copies")
    joined = recipes.alias("r").join(groups.alias("g"), F.col("r.recipe") == F.col("g.recipe"), "left")
    own, copied = F.col("r.doc_id"), F.col("g.group_size").isNotNull()
    first = own.eqNullSafe(F.col("g.best.doc_id")) & (F.col("r.size") == -F.col("g.best.size")) & F.col("r.key").eqNullSafe(F.col("g.best.key"))
    return joined.select(
        own.alias("doc_id"),
        F.when(copied, F.col("g.best.doc_id")).otherwise(own).alias("keep_id"),
        F.coalesce("g.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(copied, first).otherwise(F.lit(True)).alias("kept"),
        F.col("r.text_sha256").alias("text_sha256"),
        F.col("r.key").alias("key"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    The row that ``exact_groups`` keeps; of several, one whose whole text hashes lowest, ids missing
    or repeated as they may be. A side of any size works.
    """
    return one_of_each(docs, _judged(docs, row_key()).filter("group_size > 1").select("key", "kept"))
