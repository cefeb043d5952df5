"""Filter, deduplicate and pack ``documents``: stages that each read what the one before wrote.

Every stage takes all rows that its predecessor kept and works on whole texts. All but the last return
the columns of ``documents``, and extra ones, as they came. Null texts count as empty; an empty table
passes through; what each stage does with ties and repeated rows is stated in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import exact, language, packing, simhash, toxicity
from casebook.llm.common import table, written
from casebook.llm.queries import tokenizer_json


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels that are not held out."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scored(machine, spark, F.col("text")) < toxicity.THRESHOLD)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus: texts without a letter go, and texts that share no ranked n-gram with the
    nearest profile. If no profile could be learned, only texts without a letter go."""
    learned = language.profiles(docs)
    if not len(learned):
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language.identified(learned, spark, F.col("text"))
    return docs.filter((found["lang_pred"] != language.UNDETERMINED) & (found["distance"] < 1))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal but for white space."""
    return exact.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprint links connect."""
    return simhash.without_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 ids: a row a piece, with its place and its ids."""
    return packing.pack(docs, tokenizer_json("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", without_toxic),
    ("language", with_language),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: Classifiers and fingerprints are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
