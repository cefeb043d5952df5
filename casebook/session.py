"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="casebook-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str, within: str | None = None) -> str:
    """The URI of a new folder that driver and executors share, in the checkpoint folder if no other is named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{within or ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made_folder(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def made_folder(uri: str) -> str:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return uri


def opened(uri: str, write: bool = False):
    """A stream on a file of any store that pyarrow knows by its URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if write else system.open_input_file(path)


def kept(df: DataFrame) -> DataFrame:
    """Reuse across passes; spills to disk and is recomputed when an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stored(df: DataFrame) -> DataFrame:
    """The table written to the checkpoint folder, partition by partition, and kept from there: the plans of jobs on it end at
    its files, whatever it was made of."""
    ensure_checkpoint_dir(df.sparkSession)
    made = kept(df)
    out = kept(made.checkpoint())
    made.unpersist()
    return out


def local_session(cores: str | int = "*", partitions: int = 8, name="casebook") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
