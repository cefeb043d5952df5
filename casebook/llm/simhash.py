"""Near duplicates by SimHash and deletion variants.

A fingerprint has 64 bits. Two of them that differ in at most 4 bits agree, in one of three segments,
in all bits or in all but one: were segment A to differ at all and B and C in two bits each, that would
be 5. So A is indexed as it is, and B and C once for each of their bits with that bit deleted. Equal
index keys give candidates, which are verified. Only distinct fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import in_slices, one_of_each, record, row_key, whole_text, written
from casebook.llm.components import components

SHINGLE = 4
DISTANCE = 4
#: (lowest bit, bits, one wildcard) of each segment.
SEGMENTS = ((0, 18, False), (18, 23, True), (41, 23, True))

#: Fingerprints under one key that are compared by a join, and those of one block beyond that.
CROWD, BLOCK = 256, 1024


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in more than half of the hashes of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and six white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        part = zip(starts[i : min(n, i + (1 << 16))].tolist(), ends[shingle - 1 + i :].tolist() if len(words) >= shingle else [len(joined)])
        h = np.fromiter((hashed(joined[a:b], 42) for a, b in part), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, sha: Column) -> DataFrame:
    """doc_id, ``sha`` and ``bits``, the fingerprint as a signed 64-bit integer, of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("bits", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in in_slices(batches):
            own = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield record(schema, rows.column("doc_id"), rows.column("sha"), own)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), whole_text().alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, sha binary, bits long")


def index_keys(bits: Column) -> Column:
    """(key, one) of a fingerprint: a segment's bits, or what is left of them without one, and that one.

    Above the bits, a key holds the segment and the deleted bit. Fingerprints that agree in a whole
    segment meet under its plain key (``one`` is -1); they differ in one bit of it if they meet under a
    key without that bit and ``one`` is 0 for one of them and 1 for the other. So a pair meets at most
    once a segment.
    """
    out = []
    for low, width, wild in SEGMENTS:
        own = F.shiftrightunsigned(bits, low).bitwiseAND((1 << width) - 1)
        out.append(F.struct(own.bitwiseOR(F.lit(low << 32)).alias("key"), F.lit(-1).alias("one")))
        for i in range(width if wild else 0):
            rest = own.bitwiseAND(((1 << width) - 1) ^ (1 << i)).bitwiseOR(F.lit((low + i + 1) << 32))
            out.append(F.struct(rest.alias("key"), F.shiftright(own, i).bitwiseAND(1).cast("int").alias("one")))
    return F.array(*out)


def links(distinct: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of ``distinct.bits`` that connect what links of at most ``DISTANCE`` bits connect.

    Keys of up to ``crowd`` fingerprints give all their verified pairs. A larger crowd is cut into
    blocks, every two blocks are compared in one task, and each comparison returns a spanning forest
    of its links: no link between components is lost, and no crowd's pairs are written out.
    """
    indexed = distinct.select("bits", F.explode(index_keys(F.col("bits"))).alias("k")).select("bits", "k.key", "k.one")
    shared = written(indexed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    # An exploded table looks as small as what it was exploded from: without the hint it would be broadcast.
    met = written(indexed.hint("merge").join(shared, "key"), "simhash-index")
    left, right = (met.filter(F.col("n") <= crowd).alias(x) for x in "lr")
    one = (F.col("l.one") == 0) & (F.col("r.one") == 1) | (F.col("l.one") == -1) & (F.col("r.one") == -1) & (F.col("l.bits") < F.col("r.bits"))
    near = F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= DISTANCE
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & one & near).select(F.col("l.bits").alias("a"), F.col("r.bits").alias("b"))
    return pairs.union(_crowded(met.filter(F.col("n") > crowd), block))


def _crowded(met: DataFrame, block: int) -> DataFrame:
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("bits"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.select("bits", "key", "own", other.alias("other"))
    dealt = dealt.select("bits", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def forest(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bits = rows.column("bits").to_numpy().view(np.uint64)
        side = rows.column("own").to_numpy()
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= DISTANCE
        if key[1] != key[2]:
            near &= side[:, None] != side[None, :]
        tree = spanning_forest(near)
        return pa.table({"a": bits[tree[:, 0]].view(np.int64), "b": bits[tree[:, 1]].view(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInArrow(forest, "a long, b long")


def spanning_forest(near: np.ndarray) -> np.ndarray:
    """Edges (n, 2) of a spanning forest of a symmetric boolean matrix."""
    fresh, edges = np.ones(len(near), bool), [np.zeros((0, 2), np.int64)]
    for start in range(len(near)):
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue:
            node = queue.pop()
            new = np.flatnonzero(near[node] & fresh)
            fresh[new] = False
            edges.append(np.column_stack((np.full(len(new), node), new)))
            queue.extend(new.tolist())
    return np.concatenate(edges)


def near_groups(docs: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``docs``.

    Words are cut at ASCII white space, with A-Z in lower case; shingles are ``SHINGLE`` words joined by
    a space, repeats included. A text of fewer words is one shingle; without words (null, empty or
    only white space) the fingerprint is zero, and such texts link like any others. ``component_id`` is
    the smallest ``doc_id`` that links of at most ``DISTANCE`` differing bits reach; null if all of
    them are null. Repeated rows get a row each. An empty table gives no row. Other columns are
    ignored, whatever their names.
    """
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    members = _members(docs, F.lit(None).cast("binary"), crowd, block)
    return members.select("doc_id", digits, F.col("least.doc_id").alias("component_id"))


def _members(docs: DataFrame, sha: Column, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Every row's doc_id, sha and bits with the first (id, sha) of its component, null ids last, and its rows."""
    own = written(fingerprints(docs, sha), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    distinct = own.groupBy("bits").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    roots = components(links(distinct.select("bits"), crowd, block)).select(F.col("node").alias("bits"), "root")
    classes = written(
        distinct.join(roots, "bits", "left").select("bits", "first", "n", F.coalesce("root", "bits").alias("root")), "classes"
    )
    smallest = classes.groupBy("root").agg(F.min("first").alias("least"), F.sum("n").alias("rows"))
    return own.join(classes.join(smallest, "root").select("bits", "least", "rows"), "bits")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns.

    A row of the smallest ``doc_id`` stays, or one without ``doc_id`` if none has one; of several, one
    whose whole text hashes lowest.
    """
    rows = _members(docs, row_key()["sha"]).filter("rows > 1")
    key = F.struct(F.col("doc_id").alias("id"), "sha").alias("key")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("sha") == F.col("least.sha"))
    return one_of_each(docs, rows.select(key, kept.alias("kept")))
