"""Removal of 50-byte strings that also start in a document with a smaller id, by suffix order.

No suffix array of the whole corpus is built. Every 50-byte string is led by an anchor, the one of its 26
overlapping 25-byte grams whose hash is smallest (the leftmost on a tie), so equal strings have equal grams at
equal places, and the strings of one anchor form a context: a run of neighbouring strings. Rounds over slices
of some megabytes of distinct texts:

1. every slice sends the hashes of its grams, and learns which occur in other texts;
2. it sends the contexts of those, each once with its smallest id; contexts of one gram meet in one task,
   whose suffix array finds equal strings and the smallest id of each class;
3. it removes what the answers tell it.

Equal texts are handled first: of those, only the smallest id takes part, and copies go as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import record, shared_path, whole_text, written
from casebook.llm.suffixes import suffix_order

SPAN, GRAM = 50, 25
WIDTH = SPAN - GRAM + 1
#: Bytes of a slice, of a block of it, and of a bucket file; grams or contexts that meet in one task; symbols sorted at once.
SLICE, BLOCK, FILE = 4_000_000, 1 << 17, 64_000_000
GRAMS, CONTEXTS, SYMBOLS = 4_000_000, 100_000, 200_000
#: A gram of more contexts (each slice's different ones, summed) is not left to one task.
CROWD = 20_000
NO_ID = 2**63 - 1
#: Bytes left and right of the gram, of which every string has those of one pair at least.
SIDES = ((0, 19), (7, 13), (13, 7), (19, 0))

_MASK = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and powers of an odd base and of its inverse modulo 2 ** 64."""
    n = BLOCK + SPAN + 1
    values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return values, *out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, text, first byte, anchor, end) of all contexts of the texts that end at ``ends`` in ``data``."""
    values, powers, inverse = _powers()
    found: list[tuple[np.ndarray, ...]] = []
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for at in range(0, max(0, len(data) - SPAN + 1), BLOCK):
        part = data[at : at + BLOCK + SPAN - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * powers[:n], out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        least = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= WIDTH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WIDTH - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least & _MASK).astype(np.int64)
        text = owner[at : at + len(place)]
        start = np.flatnonzero(text == owner[at + SPAN - 1 : at + SPAN - 1 + len(place)])
        place, text = place[start], text[start]
        if not len(place):
            continue
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
        low, high = start[new], np.append(start[new[1:] - 1], start[-1]) + SPAN
        place, text = place[new], text[new]
        context = _mixed((sums[high] - sums[low]) * inverse[low]) ^ ((place - low).astype(np.uint64) << np.uint64(56))
        found.append((grams[place], context, text, low + at, place + at, high + at))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


class Slice:
    """The distinct texts of a slice, in order of their hashes, with their contexts."""

    def __init__(self, rows: pa.Table):
        shas, owns, bodies = (rows.column(c).to_pylist() for c in ("sha", "own", "text"))
        first: dict[bytes, int] = {}
        text: dict[bytes, bytes] = {}
        for sha, own, body in zip(shas, owns, bodies):
            if own is not None:
                first[sha] = min(own, first.get(sha, NO_ID))
            if body is not None:
                text[sha] = body
        self.shas = sorted(text)
        self.firsts = np.array([first[s] for s in self.shas], np.int64)
        self.ends = np.cumsum([len(text[s]) for s in self.shas], dtype=np.int64)
        self.data = np.frombuffer(b"".join(text[s] for s in self.shas), np.uint8)
        self.gram, context, self.text, self.low, self.place, self.high = anchors(self.data, self.ends)
        own = self.firsts[self.text]
        order = np.argsort(self.gram)
        gram = self.gram[order]
        same = gram[1:] == gram[:-1]
        again = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))[: len(order)]
        tied = order[again]
        order[again] = tied[np.lexsort((own[tied], context[tied], gram[again]))]
        gram, context, own = self.gram[order], context[order], own[order]
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])))[: len(order)]
        starts = np.flatnonzero(new)
        #: Distinct contexts in order of gram: their gram, an occurrence, the least and the greatest id; ``kind`` of each occurrence.
        self.kinds, self.example = gram[starts], order[starts]
        self.least = own[starts]
        self.greatest = own[np.append(starts[1:], len(order)) - 1] if len(order) else self.least
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1

    def gram_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram, in several texts, contexts, first kind) of the distinct grams, in order."""
        starts = np.flatnonzero(np.concatenate(([True], self.kinds[1:] != self.kinds[:-1]))[: len(self.kinds)])
        if not len(starts):
            return self.kinds, np.zeros(0, bool), starts, starts
        several = np.minimum.reduceat(self.least, starts) < np.maximum.reduceat(self.greatest, starts)
        return self.kinds[starts], several, np.diff(np.append(starts, len(self.kinds))), starts


def _low5(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from5(cell: bytes) -> np.ndarray:
    wide = np.zeros((len(cell) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(cell, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _home(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _distinct_texts(documents: DataFrame, slices: int, files: int) -> DataFrame:
    """A bucketed table of (slice, sha, own, text) for texts of ``SPAN`` bytes or more.

    A task sends a text once, however many rows hold it, and the smallest id it saw with each.
    """
    spark = documents.sparkSession
    schema = pa.schema([("slice", pa.int64()), ("sha", pa.binary()), ("own", pa.int64()), ("text", pa.binary())])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            new = []
            for i, (sha, own) in enumerate(zip(batch.column("sha").to_pylist(), batch.column("own").to_pylist())):
                seen = least.get(sha)
                if seen is None:
                    new.append(i)
                if seen is None or own < seen:
                    least[sha] = own
            kept = batch.take(pa.array(new, pa.int64()))
            yield record(schema, kept.column("slice"), kept.column("sha"), pa.nulls(len(new), pa.int64()), kept.column("text"))
        shas = list(least)
        homes = [int.from_bytes(s[:7], "big") % slices for s in shas]
        yield record(schema, homes, shas, [least[s] for s in shas], pa.nulls(len(shas), pa.binary()))

    home = (F.conv(F.substring(F.hex("sha"), 1, 14), 16, 10).cast("long") % slices).alias("slice")
    long = documents.filter(F.col("n_bytes") >= SPAN).select("sha", "own", home, F.col("text").cast("binary").alias("text"))
    sent = long.mapInArrow(once, "slice long, sha binary, own long, text binary").repartition(files, "slice")
    name = f"passages_{uuid.uuid4().hex}"
    sent.write.bucketBy(files, "slice").option("path", shared_path(spark, "passages")).saveAsTable(name)
    return spark.table(name)


def _shared_grams(texts: DataFrame, buckets: int, crowd: int) -> DataFrame:
    """(slice, bucket, shared, hot, n, n_hot): bits for the slice's grams of a bucket, in order, and how many are set."""
    sent = pa.schema([("bucket", pa.int64()), ("slice", pa.int64())] + [(c, pa.binary()) for c in ("grams", "several", "more", "contexts")])

    def sends(rows: pa.Table) -> pa.Table:
        grams, several, contexts, _ = Slice(rows).gram_table()
        home = _home(grams, buckets)
        own = rows.column("slice")[0].as_py()
        out = []
        for b in np.unique(home).tolist():
            mine = home == b
            counts = contexts[mine]
            more = np.flatnonzero(counts > 1).astype(np.int32)
            out.append((b, own, _low5(grams[mine]), np.packbits(several[mine]).tobytes(), more.tobytes(), counts[more].astype(np.int32).tobytes()))
        return pa.Table.from_batches([record(sent, *(zip(*out) if out else [[]] * len(sent)))])

    def meets(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cells = rows.to_pylist()
        lists = [_from5(c["grams"]) for c in cells]
        grams, which = np.unique(np.concatenate(lists), return_inverse=True)
        bounds = np.cumsum([0, *[len(x) for x in lists]])
        parts = [which[a:b] for a, b in zip(bounds, bounds[1:])]
        holders = np.bincount(which, minlength=len(grams))
        contexts, several = holders.copy(), np.zeros(len(grams), bool)
        for c, part in zip(cells, parts):
            several[part[np.unpackbits(np.frombuffer(c["several"], np.uint8), count=len(part)).astype(bool)]] = True
            contexts[part[np.frombuffer(c["more"], np.int32)]] += np.frombuffer(c["contexts"], np.int32) - 1
        shared = (holders > 1) | several
        hot = shared & (contexts > crowd)
        columns = [
            [c["slice"] for c in cells],
            [key[0].as_py()] * len(cells),
            [np.packbits(shared[p]).tobytes() for p in parts],
            [np.packbits(hot[p]).tobytes() for p in parts],
            [int(shared[p].sum()) for p in parts],
            [int(hot[p].sum()) for p in parts],
        ]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["slice", "bucket", "shared", "hot", "n", "n_hot"])

    messages = texts.groupBy("slice").applyInArrow(sends, "bucket long, slice long, grams binary, several binary, more binary, contexts binary")
    answers = messages.groupBy("bucket").applyInArrow(meets, "slice long, bucket long, shared binary, hot binary, n long, n_hot long")
    return written(answers, "passage-grams")


def _wanted(own: Slice, answers: list[dict], buckets: int, hot: bool) -> np.ndarray:
    """The kinds of a slice whose gram other texts share; only those of hot grams, or only the others."""
    grams, _, _, starts = own.gram_table()
    chosen = np.zeros(len(grams), bool)
    home = _home(grams, buckets)
    for a in answers:
        mine = np.flatnonzero(home == a["bucket"])
        shared, crowd = (np.unpackbits(np.frombuffer(a[c], np.uint8), count=len(mine)).astype(bool) for c in ("shared", "hot"))
        chosen[mine] = shared & (crowd if hot else ~crowd)
    return np.flatnonzero(np.repeat(chosen, np.diff(np.append(starts, len(own.kinds)))))


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``data``, one behind the other."""
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return data[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


_CONTEXT = pa.schema([("bucket", pa.int64()), ("slice", pa.int64())] + [(c, pa.binary()) for c in ("kinds", "grams", "least", "several", "left", "right", "body")])
_RUN = pa.schema([("slice", pa.int64())] + [(c, pa.binary()) for c in ("kinds", "start", "stop", "least")])


def _contexts(texts: DataFrame, answers: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """Contexts of shared grams, packed by slice and by the task that sorts them: bytes left and right of the gram."""

    def sends(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not len(rows):
            return _CONTEXT.empty_table()
        own = Slice(rows)
        kinds = _wanted(own, known.to_pylist(), buckets, hot=False)
        at = own.example[kinds]
        low, place, high = own.low[at], own.place[at], own.high[at]
        left, right = place - low, high - place - GRAM
        task = ((own.kinds[kinds] >> np.uint64(8)) % np.uint64(tasks)).astype(np.int64)
        out = []
        for t in np.unique(task).tolist():
            m = np.flatnonzero(task == t)
            starts, sizes = np.column_stack((low[m], place[m] + GRAM)).ravel(), np.column_stack((left[m], right[m])).ravel()
            several = own.greatest[kinds[m]] > own.least[kinds[m]]
            cells = (kinds[m].astype(np.int32), own.kinds[kinds[m]], own.least[kinds[m]], several, left[m].astype(np.uint8), right[m].astype(np.uint8))
            out.append((t, rows.column("slice")[0].as_py(), *[c.tobytes() for c in cells], _gathered(own.data, starts, sizes).tobytes()))
        return pa.Table.from_batches([record(_CONTEXT, *(zip(*out) if out else [[]] * len(_CONTEXT)))])

    shape = "bucket long, slice long, " + ", ".join(f"{f.name} binary" for f in _CONTEXT if f.name not in ("bucket", "slice"))
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(sends, shape)


def least_ids(contexts: list[tuple[int, bytes, bytes]], least: np.ndarray) -> list[np.ndarray]:
    """For each context (gram, bytes left of it, bytes right of it) the smallest id that has each of its strings.

    Contexts must differ. A gram is one symbol of the text to be sorted, and another for each gram, so only
    strings of the same gram and place can be equal; they stand next to each other in suffix order.
    """
    text: list[int] = []
    begins, widths = [], []
    symbols: dict[int, int] = {}
    for gram, left, right in contexts:
        begins.append(len(text))
        widths.append(len(left) + GRAM + len(right) - SPAN + 1)
        text.extend(b + 1 for b in left)
        text.append(257 + symbols.setdefault(gram, len(symbols)))
        text.extend(b + 1 for b in right)
        text.append(0)
    widths, flat = np.array(widths), np.array(text, np.int64)
    owner = np.repeat(np.arange(len(contexts)), widths)
    first = np.concatenate(([0], np.cumsum(widths)[:-1]))
    starts = np.repeat(np.array(begins) - first, widths) + np.arange(len(owner))
    number = np.full(len(text), -1)
    number[starts] = np.arange(len(starts))
    order = number[np.array(suffix_order(text))]
    order = order[order >= 0]  # the strings, in suffix order
    shown = flat[starts[order][:, None] + np.arange(WIDTH)]
    heads = np.flatnonzero(np.concatenate(([True], (shown[1:] != shown[:-1]).any(axis=1))))
    smallest = np.minimum.reduceat(least[owner[order]], heads)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(smallest, np.diff(np.append(heads, len(order))))
    return np.split(out, np.cumsum(widths)[:-1])


def _alike(texts: list[tuple[int, bytes, bytes]], contexts: list[int]) -> list[int]:
    """Those of one gram's contexts that may hold a string of another one.

    A string has at least 19 bytes on one side of its gram, or 13 on one and 7 on the other, so two contexts
    with a string in common agree in one of four such pairs of sides.
    """
    if len(contexts) < 2:
        return []
    seen: dict[tuple[int, bytes, bytes], int] = {}
    keys = []
    for i in contexts:
        _, left, right = texts[i]
        own = [(a, left[len(left) - a :], right[:b]) for a, b in SIDES if len(left) >= a and len(right) >= b]
        keys.append(own)
        for k in own:
            seen[k] = seen.get(k, 0) + 1
    return [i for i, own in zip(contexts, keys) if any(seen[k] > 1 for k in own)]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, b, int(values[a])


def _sorted_contexts(contexts: DataFrame) -> DataFrame:
    """Runs (kind, first and last string, smallest id) of contexts from which something may go, packed by slice."""

    def sorts(rows: pa.Table) -> pa.Table:
        index: dict[tuple[int, bytes, bytes], int] = {}
        members: list[tuple[int, int, int, bool]] = []  # slice, kind, context, several
        ids: list[int] = []
        for row in rows.to_pylist():
            kinds, grams = np.frombuffer(row["kinds"], np.int32).tolist(), np.frombuffer(row["grams"], np.uint64).tolist()
            least, several = np.frombuffer(row["least"], np.int64).tolist(), np.frombuffer(row["several"], bool).tolist()
            left, right, body, at = row["left"], row["right"], row["body"], 0
            for kind, gram, own, more, a, b in zip(kinds, grams, least, several, left, right):
                context = index.setdefault((gram, body[at : at + a], body[at + a : at + a + b]), len(index))
                at += a + b
                if context == len(ids):
                    ids.append(own)
                elif own < ids[context]:
                    ids[context] = own
                members.append((row["slice"], kind, context, more or own))
        by_gram: dict[int, list[int]] = {}
        texts = list(index)
        for i, (gram, _, _) in enumerate(texts):
            by_gram.setdefault(gram, []).append(i)
        answers: list[np.ndarray | None] = [None] * len(texts)
        batch, size = [], 0
        for contexts in [*by_gram.values(), None]:
            if batch and (contexts is None or size > SYMBOLS):
                for i, found in zip(batch, least_ids([texts[i] for i in batch], np.array([ids[i] for i in batch]))):
                    answers[i] = found
                batch, size = [], 0
            near = _alike(texts, contexts or [])
            batch += near
            size += sum(len(texts[i][1]) + len(texts[i][2]) + 2 for i in near)
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for home, kind, i, own in members:
            found = answers[i]
            if found is None:
                width = len(texts[i][1]) + len(texts[i][2]) + GRAM - SPAN + 1
                runs = [(0, width, ids[i])]
            else:
                runs = _runs(found)
            out.setdefault(home, []).extend((kind, a, b, v) for a, b, v in runs if own is True or v < own)
        cells = []
        for home, found in out.items():
            if found:
                kind, start, stop, value = zip(*found)
                arrays = (np.array(kind, np.int32), np.array(start, np.uint8), np.array(stop, np.uint8), np.array(value, np.int64))
                cells.append((home, *[a.tobytes() for a in arrays]))
        return pa.Table.from_batches([record(_RUN, *(zip(*cells) if cells else [[]] * len(_RUN)))])

    shape = "slice long, " + ", ".join(f"{f.name} binary" for f in _RUN if f.name != "slice")
    return contexts.groupBy("bucket").applyInArrow(sorts, shape)


def _compared_strings(texts: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Runs of the hot grams' contexts: each string a row, summed before it is shuffled, for grams too frequent for one task."""
    schema = pa.schema([("slice", pa.int64()), ("kind", pa.int64()), ("at", pa.int64()), ("least", pa.int64()), ("string", pa.binary())])

    def sends(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        own = Slice(rows)
        kinds = _wanted(own, known.to_pylist(), buckets, hot=True)
        at = own.example[kinds]
        widths = own.high[at] - own.low[at] - SPAN + 1
        place = np.arange(int(widths.sum())) - np.repeat(np.concatenate(([0], np.cumsum(widths)[:-1])), widths)
        starts = np.repeat(own.low[at], widths) + place
        strings = own.data[starts[:, None] + np.arange(SPAN)] if len(starts) else np.zeros((0, SPAN), np.uint8)
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SPAN), len(starts), [None, pa.py_buffer(strings.tobytes())])
        home = np.full(len(starts), rows.column("slice")[0].as_py())
        return pa.Table.from_batches([record(schema, home, np.repeat(kinds, widths), place, np.repeat(own.least[kinds], widths), column)])

    strings = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(sends, "slice long, kind long, at long, least long, string binary")
    strings = written(strings, "passage-strings")
    smallest = written(strings.groupBy("string").agg(F.min("least").alias("v")), "passage-classes")
    packed = strings.join(smallest, "string").select("slice", "kind", "at", "v")

    def packs(rows: pa.Table) -> pa.Table:
        kind, at, v = (rows.column(c).to_numpy() for c in ("kind", "at", "v"))
        cells = (kind.astype(np.int32), at.astype(np.uint8), (at + 1).astype(np.uint8), v.astype(np.int64))
        return pa.Table.from_batches([record(_RUN, [rows.column("slice")[0].as_py()], *[[c.tobytes()] for c in cells])])

    return packed.groupBy("slice").applyInArrow(packs, "slice long, kinds binary, start binary, stop binary, least binary")


def _removed(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(sha, first, n_removed, n_spans, kept) of every distinct text: its smallest id and what is left of it there."""
    schema = pa.schema([("sha", pa.binary()), ("first", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])

    def removes(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        own = Slice(rows)
        cells = known.to_pylist()
        kinds, start, stop, value = (
            np.concatenate([np.zeros(0, t), *[np.frombuffer(c[name], t) for c in cells]])
            for name, t in (("kinds", np.int32), ("start", np.uint8), ("stop", np.uint8), ("least", np.int64))
        )
        # A kind's runs, for each of its occurrences: rows of both are in order of kind.
        order = np.argsort(kinds, kind="stable")
        kinds, start, stop, value = kinds[order], start[order].astype(np.int64), stop[order].astype(np.int64), value[order]
        a, b = np.searchsorted(kinds, own.kind, side="left"), np.searchsorted(kinds, own.kind, side="right")
        each = np.repeat(np.arange(len(a)), b - a)
        run = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)[: len(each)] + np.arange(len(each)) if len(each) else each
        goes = value[run] < own.firsts[own.text[each]]
        each, run = each[goes], run[goes]
        change = np.zeros(len(own.data) + 1, np.int64)
        np.add.at(change, own.low[each] + start[run], 1)
        np.add.at(change, own.low[each] + stop[run] + SPAN - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for sha, first, begin, end in zip(own.shas, own.firsts.tolist(), np.concatenate(([0], own.ends[:-1])).tolist(), own.ends.tolist()):
            mine = gone[begin:end]
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
            kept = hashlib.sha256(own.data[begin:end][~mine].tobytes()).hexdigest() if spans else sha.hex()
            out.append((sha, first, int(mine.sum()), spans, kept))
        return pa.Table.from_batches([record(schema, *zip(*out))])

    shape = "sha binary, first long, n_removed long, n_spans long, kept string"
    return texts.groupBy("slice").cogroup(runs.groupBy("slice")).applyInArrow(removes, shape)


def without_passages(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row's whole text in UTF-8.

    A byte goes if it lies in a string of ``SPAN`` bytes that also starts in a text with a smaller doc_id; strings
    are judged on the texts as they came. A null doc_id counts as greater than all others; rows that share a
    doc_id, or have none, remove nothing from each other. Null texts count as empty; texts of fewer than
    ``SPAN`` bytes stay whole. Repeated rows get a row each. An empty table gives no row. Other columns are
    ignored, whatever their names. Strings count as equal if all but the 25 bytes of their anchor are equal and
    those agree in a hash of 64 bits. Grams of more than ``crowd`` contexts are compared string by string.
    """
    text = whole_text()
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), text.alias("text"))
    docs = docs.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows = written(docs.drop("text"), "passage-rows")
    total = rows.filter(F.col("n_bytes") >= SPAN).agg(F.sum("n_bytes")).first()[0] or 0
    files = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE))
    texts = _distinct_texts(docs, max(1, -(-total // SLICE)), files)
    buckets = max(1, -(-total * 2 // ((WIDTH + 1) * GRAMS)))
    answers = _shared_grams(texts, buckets, crowd)
    shared, hot = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_hot"), F.lit(0))).first()
    known = answers.select("slice", "bucket", "shared", "hot")
    runs = _sorted_contexts(_contexts(texts, known, buckets, max(1, -(-shared // CONTEXTS))))
    if hot:
        runs = runs.unionByName(_compared_strings(texts, known, buckets))
    outcome = written(_removed(texts, written(runs, "passage-runs")), "passage-outcomes")
    nothing = F.sha2(F.lit(""), 256)
    copy = F.coalesce(F.col("own") > F.col("first"), F.lit(False))
    return rows.join(outcome, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
