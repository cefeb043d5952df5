"""The derived matrices, persisted for operators that pass over them several times.

Spark recognises an equal plan, so queries of one session share the stored copy.
"""

from __future__ import annotations

from casebook.session import kept
from casebook.sources import tables
from casebook.sources.tables import *  # noqa: F401,F403
from casebook.sources.tables import table  # noqa: F401


def orders_matrix(spark, sf_dir):
    df, spec = tables.orders_matrix(spark, sf_dir)
    return kept(df), spec


def orders_survival(spark, sf_dir):
    df, spec = tables.orders_survival(spark, sf_dir)
    return kept(df), spec


def docs_matrix(spark, sf_dir):
    df, spec = tables.docs_matrix(spark, sf_dir)
    return kept(df), spec


def embeddings_matrix(spark, sf_dir):
    df, spec = tables.embeddings_matrix(spark, sf_dir)
    return kept(df), spec


def predictions(spark, sf_dir):
    return kept(tables.predictions(spark, sf_dir))


def paired_predictions(spark, sf_dir):
    return kept(tables.paired_predictions(spark, sf_dir))


