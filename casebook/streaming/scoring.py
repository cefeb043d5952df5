"""Scoring with a saved model: the same projection on a batch or a streaming table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.exprs import col
from casebook.operators import models, normalize, reduce
from casebook.session import shared_folder
from casebook.spec import MatrixSpec


def score(df: DataFrame, spec: MatrixSpec, prepared: dict, out="pred") -> DataFrame:
    """Normalise, reduce, select and predict with fitted state; no aggregate, no shuffle."""
    raw = spec.only(prepared["raw_features"])
    scaled = normalize.apply_normalizer(raw.project(df), raw, prepared["normalizer"])
    state = prepared.get("reducer")
    if state and "loadings" in state:
        scaled, _ = reduce.apply_pca(scaled, raw, state)
    keys = spec.keys
    picked = scaled.select(*keys, *prepared["features"])
    return prepared["model"].predict(picked, out).select(*keys, out)


def apply_cutoff(scored: DataFrame, cutoff: float, pred="pred") -> DataFrame:
    return scored.withColumn("called", (col(pred) >= F.lit(float(cutoff))).cast("int"))


def save_prepared(spark: SparkSession, prepared: dict, path: str) -> None:
    """Stage state as one JSON row, with the Spark ML model (if any) next to it."""
    model = prepared["model"]
    if isinstance(model, models.ForestScore):
        model = model.copied(shared_folder(spark, "trees", f"{path}/trees"))
    fields = {k: v for k, v in vars(model).items() if k != "model"}
    state = {**{k: v for k, v in prepared.items() if k != "model"}, "kind": type(model).__name__, "fields": fields}
    spark.range(1).select(F.lit(json.dumps(state)).alias("state")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/state"
    )
    if isinstance(model, models.TransformerScore):
        model.model.write().overwrite().save(f"{path}/model")


def _tuples(x):
    return tuple(_tuples(v) for v in x) if isinstance(x, list) else x


def load_prepared(spark: SparkSession, path: str) -> dict:
    state = json.loads(spark.read.parquet(f"{path}/state").head().state)
    kind = getattr(models, state.pop("kind"))
    fields = {k: _tuples(v) for k, v in state.pop("fields").items()}
    if kind is models.TransformerScore:
        from pyspark.ml.util import DefaultParamsReader

        meta = DefaultParamsReader.loadMetadata(f"{path}/model", spark)
        fields["model"] = _load_model(meta["class"], f"{path}/model")
    return {**state, "model": kind(**fields)}


def _load_model(java_class: str, path: str):
    from pyspark.ml import classification

    return getattr(classification, java_class.rsplit(".", 1)[-1]).load(path)


def score_stream(spark: SparkSession, folder: str, schema, spec: MatrixSpec, prepared: dict, **options) -> DataFrame:
    """Scores of matrix rows arriving as parquet files in ``folder``."""
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    return score(stream, spec, prepared)
