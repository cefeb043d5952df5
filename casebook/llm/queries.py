"""One query an operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import bpe, conversations, exact, language, licenses, neighbours, packing, passages, simhash, tokencount, tokenstore, toxicity, whitening
from casebook.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer_json(name: str) -> str:
    """A vocabulary file as text; it is read on the driver and goes to the tasks with the job."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query("op1_token_store")
def op1_token_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    store = tokenstore.write_store(docs, tokenizer_json("byte_bpe_50k.json"), end_id=2)
    rows = tokenstore.read_rows(store, tokenstore.stored_rows(store, docs))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"), end_id=0)
    return pieces.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.col("offset").cast("long").alias("offset"),
    )


@query(
    "op4_exact_dedup",
    r"WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, "
    r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS clean FROM documents), "
    "g AS (SELECT clean, first(doc_id ORDER BY size DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY clean) "
    "SELECT t.doc_id, keep_id, group_size, t.doc_id = keep_id AS kept, sha256(t.clean) AS text_sha256 FROM t JOIN g USING (clean)",
)
def op4_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op9_license_scan", licenses.oracle_sql())
def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    vocabulary = tokenizer_json("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_kmeans_tree")
def op5_kmeans_tree(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    return tokencount.section_tokens(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"))


@query("op10_language")
def op10_language(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark, sf_dir):
    return passages.without_passages(table(spark, sf_dir, "documents"))
