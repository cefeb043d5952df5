"""Token ids in binary shards, with a perfect-hash index from document to place.

A store is a folder in a file system that all machines share:

``payload/shard-<no>-<attempt>.bin``  ids only, little-endian, two bytes each if the vocabulary
allows it, else four; documents in ascending ``doc_id`` order without gaps;
``entries``  Parquet, a row a stored document: shard, file, first id in the shard, number of ids;
``index``    Parquet, a row a bucket of keys: its number, the number of buckets, and a dumped ``KeyIndex`` from ``doc_id`` to
(shard, first id, number of ids, stored rows).

Payload files are named after the task attempt; only those that a committed row of ``entries``
names belong to the store, so a task that is lost and run again leaves no wrong data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import in_slices, record, shared_path, whole_text
from casebook.llm.perfecthash import KeyIndex
from casebook.llm.wordcodec import encoder, load

KEYS_A_BUCKET = 50_000
SHARDS_A_BLOCK = 1024
ENTRY = "doc_id long, shard int, file string, first long, n_tokens long"
INDEX = "bucket long, buckets long, data binary"
FOUND = "doc_id long, shard int, first long, n_tokens long, stored_rows long"


def opened(uri: str, write: bool = False):
    """A stream on a file of any store that pyarrow knows by its URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if write else system.open_input_file(path)


def make_folder(uri: str) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)


@dataclass(frozen=True)
class TokenStore:
    spark: SparkSession
    path: str
    width: int  # bytes an id

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def shards(self) -> DataFrame:
        """A row a shard: its file and ``before``, the ids of all shards before it.

        Sums go through blocks of shards, so that no task orders more than a block or one row a block.
        """
        totals = self.entries().groupBy("shard", "file").agg(F.sum("n_tokens").alias("total"))
        totals = totals.withColumn("block", F.floor(F.col("shard") / SHARDS_A_BLOCK))
        upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = totals.groupBy("block").agg(F.sum("total").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
        inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        own = totals.withColumn("own", F.coalesce(F.sum("total").over(inside), F.lit(0)))
        return own.join(blocks, "block").select("shard", "file", (F.col("base") + F.col("own")).alias("before"))


def write_store(docs: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None) -> TokenStore:
    """Encode the whole ``text`` of every row, append ``end_id``, and store it.

    Null texts count as empty (one id, the end). Rows that share a ``doc_id`` are stored side by side
    in the order of their text's hash, and the index leads to the first with their number. Rows with
    null ``doc_id`` come first; they have entries but no key. An empty table makes an empty store.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    size = max(load(tokenizer_json).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    make_folder(f"{path}/payload")

    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("n_tokens", pa.int64())])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stream, file, at = TaskContext.get().partitionId(), None, "", 0
        code = encoder(vocabulary.value)
        try:
            for rows, texts in in_slices(batches):
                if stream is None:
                    file = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    stream = opened(f"{path}/payload/{file}", write=True)
                ids = [np.append(x, np.uint32(end_id)) for x in code.encode(texts)]
                stream.write(np.concatenate(ids).astype(f"<u{width}").tobytes())
                lengths = np.array([len(x) for x in ids], np.int64)
                ends = at + np.cumsum(lengths)
                yield record(schema, rows.column("doc_id"), [shard] * len(ids), [file] * len(ids), ends - lengths, lengths)
                at = int(ends[-1])
        finally:
            if stream is not None:
                stream.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    order = ("doc_id", "text_hash")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(stored, ENTRY).write.parquet(f"{path}/entries")
    store = TokenStore(spark, path, width)
    _write_index(store)
    return store


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def _write_index(store: TokenStore) -> None:
    entries = store.entries().filter("doc_id IS NOT NULL")
    keys = entries.groupBy("doc_id").agg(F.min(F.struct("shard", "first", "n_tokens")).alias("place"), F.count("*").alias("stored_rows"))
    buckets = max(1, -(-entries.count() // KEYS_A_BUCKET))

    def built(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        values = frame[["shard", "first", "n_tokens", "stored_rows"]].to_numpy(np.int64)
        return pd.DataFrame({"bucket": [key[0]], "buckets": [buckets], "data": [KeyIndex.build(frame["doc_id"].to_numpy(np.int64), values).dump()]})

    flat = keys.select(_bucket(buckets).alias("bucket"), "doc_id", "place.shard", "place.first", "place.n_tokens", "stored_rows")
    flat.groupBy("bucket").applyInPandas(built, INDEX).write.parquet(f"{store.path}/index")


def look_up(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Places of the distinct keys ``doc_id``: shard, file, first id, ids and stored rows; unknown keys give no row."""
    buckets = store.index().agg(F.max("buckets")).first()[0] or 1  # an index of no keys has no row

    def found(key: tuple[Any, ...], wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(index):
            return pd.DataFrame({"doc_id": [], "shard": [], "first": [], "n_tokens": [], "stored_rows": []}).astype("int64")
        ids = wanted["doc_id"].to_numpy(np.int64)
        hit, values = KeyIndex.load(index["data"].iloc[0]).find(ids)
        out = pd.DataFrame(values[hit], columns=["shard", "first", "n_tokens", "stored_rows"])
        out.insert(0, "doc_id", ids[hit])
        return out

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    wanted = wanted.select(_bucket(buckets).alias("bucket"), "doc_id")
    return wanted.groupBy("bucket").cogroup(store.index().groupBy("bucket")).applyInPandas(
        found, FOUND
    )


def stored_rows(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Places of every stored row of the keys: the indexed one, and from ``entries`` those after it."""
    places = look_up(store, keys)
    files = store.shards()
    first = places.join(files, "shard").select("doc_id", "shard", "file", "before", "first", "n_tokens")
    repeated = places.filter("stored_rows > 1").select("doc_id", F.struct("shard", "first").alias("indexed"))
    more = (
        store.entries().join(repeated, "doc_id").filter(F.struct("shard", "first") > F.col("indexed")).drop("indexed", "file").join(files, "shard")
    )
    keyless = store.entries().filter("doc_id IS NULL").drop("file").join(files, "shard")
    columns = ["doc_id", "shard", "file", "before", "first", "n_tokens"]
    return first.unionByName(more.select(columns)).unionByName(keyless.select(columns))


def read_rows(store: TokenStore, places: DataFrame) -> DataFrame:
    """``places`` with ``ids``, the stored ids as little-endian unsigned 32-bit integers, read by byte range.

    Rows of a shard come one after the other, so that a file is opened once a task and read forwards.
    """
    folder, width = f"{store.path}/payload", store.width
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream = None, None
        for batch in batches:
            rows, done = batch.to_pydict(), 0
            while done < batch.num_rows:
                begun, starts, out, size = done, [], [], 0
                while done < batch.num_rows and size < 8_000_000:
                    if rows["file"][done] != file:
                        if stream is not None:
                            stream.close()
                        file = rows["file"][done]
                        stream = opened(f"{folder}/{file}")
                    first, n = rows["first"][done], rows["n_tokens"][done]
                    stream.seek(first * width)
                    data = stream.read(n * width)
                    if len(data) != n * width:
                        raise OSError(f"{file} ends before document {rows['doc_id'][done]}")
                    ids = data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()
                    starts.append(rows["before"][done] + first)
                    out.append(ids)
                    size, done = size + len(ids), done + 1
                yield record(schema, rows["doc_id"][begun:done], starts, rows["n_tokens"][begun:done], out)
        if stream is not None:
            stream.close()

    ordered = places.repartitionByRange("shard", "first").sortWithinPartitions("shard", "first")
    return ordered.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


