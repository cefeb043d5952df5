"""Repair of conversations: the cheapest edits that make the roles alternate, by a Viterbi run over chunks.

A conversation's rows pass through four states (nothing yet, after a system row, after a user row, after an
assistant row). Its rows are cut into chunks that are worked on side by side. Every chunk first runs backward
from a speculative vector of costs, that of a conversation's end. Fix-up passes hand each chunk the vector
its successor found, and rerun it only until the vectors differ by a constant, from where the old run holds.
A run whose vectors never meet (long stretches of rows that all must go) is not passed on chunk by chunk
for ever: after ``PASSES`` passes the cost matrices of its chunks are multiplied in doubling steps. The stitched
backward costs then lead a forward trace, which takes the least letter among the cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import written

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a chunk, and fix-up passes before matrices take over.
CHUNK, PASSES = 4096, 3
#: Characters of a text that order rows of equal turn and role before the hash of the whole text does.
PREFIX = 32

START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = np.array([USER, USER, ASSISTANT, USER])  # the state after an inserted row
END = np.array([0, 2 * INSERT, INSERT, 0])  # cheapest way to end in each state
FAR = 1 << 40

#: Faults of a row, in a code of four times its role (s, u, a, other) plus the fault.
FINE, CUT_OFF, DUPLICATE, BLANK = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
LETTERS = ("D", "K", "R", "IK", "IR")
PRICES = np.array([DELETE, KEEP, REROLE, INSERT + KEEP, INSERT + REROLE])
TAILS = ("", "II", "I", "")
NAMES = ("user", "user", "assistant", "user")  # the role of what is inserted or rewritten in each state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` after the damage that crc32 of ``conv_id:turn`` decides; nulls count as a space."""
    part = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    turn = F.col("turn").cast("long").alias("turn")
    rows = conversations.select("conv_id", turn, _text("role").alias("role"), _text("text").alias("text"), part.alias("part"))
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("part") == 3, 2).otherwise(1).cast("long")
    return rows.filter("part != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _sized(*columns: Column) -> Column:
    """A binary hash of several values, nulls told apart from texts."""
    sized = [F.concat(F.coalesce(F.length(c.cast("string")), F.lit(-1)), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def _keyed(rows: DataFrame) -> DataFrame:
    sha = F.sha2("text", 256)
    c = F.col
    return rows.withColumn("said", _sized(c("conv_id"), c("role"), sha)).withColumn("row", _sized(c("conv_id"), c("turn"), c("role"), sha))


def _coded(rows: DataFrame) -> DataFrame:
    """One row for each different (conv_id, turn, role, text), with its copies and its code."""
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(shown == "", BLANK).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    own = _keyed(rows).select("conv_id", "turn", "role", F.left("text", F.lit(PREFIX)).alias("head"), "said", "row", fault.alias("fault"), "copies")
    each = own.groupBy("conv_id", "turn", "role", "head", "said", "row", "fault").agg(F.sum("copies").alias("copies"))
    each = written(each, "conversation-rows")
    first = each.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").select("said", F.col("first.turn").alias("first"), F.lit(True).alias("again")), "conversation-repeats")
    later = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault"))
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = (role * 4 + fault).cast("int").alias("code")
    return each.join(first, "said", "left").select("conv_id", "turn", "role", "head", "row", code, "copies")


# Array work on many chunks at once: ``ends`` and ``lengths`` place each chunk's codes in one flat array.


def _step(after: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Vectors (n, 4) of costs before a row from those after it."""
    role, fault = code >> 2, code & 3
    extra = np.where(fault == CUT_OFF, TRUNCATED, 0)
    keep = np.full((len(code), 4), FAR)
    keep[:, START] = np.where(role == 0, after[:, SYSTEM], np.where(role == 1, after[:, USER], FAR))
    keep[:, SYSTEM] = keep[:, ASSISTANT] = np.where(role == 1, after[:, USER], FAR)
    keep[:, USER] = np.where(role == 2, after[:, ASSISTANT], FAR)
    stays = np.minimum(keep, REROLE + after[:, INSERTED]) + extra[:, None]
    stays[fault >= DUPLICATE] = FAR
    best = np.minimum(stays, DELETE + after)
    best[:, USER] = np.minimum(best[:, USER], INSERT + best[:, ASSISTANT])
    for state in (START, SYSTEM, ASSISTANT):
        best[:, state] = np.minimum(best[:, state], INSERT + best[:, USER])
    return best


def _level(vectors: np.ndarray) -> np.ndarray:
    return vectors - vectors.min(axis=1, keepdims=True)


def backward(codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors before every row, vectors before every chunk) from the vectors after each chunk."""
    before = np.empty((len(codes), 4), np.int64)
    order = np.argsort(-lengths, kind="stable")
    now, counts = right[order].astype(np.int64), -lengths[order]
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(counts, -t))
        at = ends[order[:live]] - 1 - t
        now[:live] = _step(now[:live], codes[at])
        before[at] = now[:live]
    left = np.empty_like(now)
    left[order] = now
    return before, left


def fixed_up(codes, ends, lengths, old_right, old_left, right) -> np.ndarray:
    """Vectors before every chunk for new vectors after it; a chunk is left as soon as old and new run differ by a constant."""
    out = old_left.copy()
    live = np.arange(len(ends))
    old, new = old_right.astype(np.int64), right.astype(np.int64)
    t = 0
    while len(live):
        differ = (_level(old) != _level(new)).any(axis=1)
        live, old, new = live[differ], old[differ], new[differ]
        done = lengths[live] == t
        out[live[done]] = _level(new[done])
        live, old, new = live[~done], old[~done], new[~done]
        code = codes[ends[live] - 1 - t]
        old, new = _step(old, code), _step(new, code)
        t += 1
    return out


def traced(codes, ends, lengths, before, right, entry) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``LETTERS`` for every row, state after each chunk): the least letter among the cheapest, row by row."""
    edits = np.zeros(len(codes), np.int8)
    order = np.argsort(-lengths, kind="stable")
    state, counts = entry[order].astype(np.int64), -lengths[order]
    starts = ends - lengths
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(counts, -t))
        chunk = order[:live]
        at = starts[chunk] + t
        last = lengths[chunk] == t + 1
        after = np.where(last[:, None], right[chunk], before[np.minimum(at + 1, len(codes) - 1)])
        here, each = before[at], np.arange(live)
        own = state[:live]
        role, fault = codes[at] >> 2, codes[at] & 3
        gone = (fault >= DUPLICATE) | (DELETE + after[each, own] == here[each, own])
        moved = INSERTED[own]
        insert = ~gone & (INSERT + here[each, moved] == here[each, own])
        own = np.where(insert, moved, own)
        system = (own == START) & (role == 0)
        allowed = system | (own != USER) & (role == 1) | (own == USER) & (role == 2)
        onto = np.where(system, SYSTEM, INSERTED[own])
        extra = np.where(fault == CUT_OFF, TRUNCATED, 0)
        kept = ~gone & allowed & (after[each, onto] + extra == here[each, own])
        edits[at] = np.where(gone, 0, np.where(kept, 1, 2) + 2 * insert)
        state[:live] = np.where(gone, own, np.where(kept, onto, INSERTED[own]))
    out = np.empty_like(state)
    out[order] = state
    return edits, out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy().astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.cumsum(lengths), lengths


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).astype(np.int64)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), matrix.reshape(-1))


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows in order of conversation and turn, cut into chunks of one conversation each, with the speculative vector before them.

    ``part`` and ``seq`` name a chunk and order those of a conversation.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("head"), F.col("row")]
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, part int, seq long, codes array<int>, copies array<long>, rows array<binary>, roles array<string>, lefts array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            conv = batch.column("conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            run = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            starts = np.flatnonzero(run % chunk == 0)
            offsets = pa.array(np.append(starts, n), pa.int32())
            codes = batch.column("code").to_numpy().astype(np.int64)
            lengths = np.diff(np.append(starts, n))
            _, left = backward(codes, starts + lengths, lengths, np.tile(END, (len(starts), 1)))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("code", "copies", "row", "role")]
            ids = batch.column("conv_id").take(pa.array(starts))
            columns = [ids, pa.array(np.full(len(starts), part, np.int32)), pa.array(np.arange(seq, seq + len(starts))), *lists, _lists(_level(left))]
            seq += len(starts)
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seq", "codes", "copies", "rows", "roles", "lefts"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = ranged.select("conv_id", "role", "row", "code", "copies")
    return written(narrow.mapInArrow(cut, out), "conversation-chunks")


def _linked(cut: DataFrame) -> DataFrame:
    """part, seq, the conversation's key, place and number of its chunks, and the chunk's speculative vectors."""
    key = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id").alias("conv")
    spans = cut.groupBy(key, "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy("conv").orderBy("part")  # at most a row for each range partition
    spans = spans.withColumn("past", F.sum("n").over(by) - F.col("n")).withColumn("chunks", F.sum("n").over(Window.partitionBy("conv")))
    end = F.array(*[F.lit(int(v)).cast("long") for v in END])
    own = cut.select(key, "part", "seq", "lefts").join(spans, ["conv", "part"])
    at = (F.col("past") + F.col("seq") - F.col("first")).alias("at")
    return written(own.select("conv", at, "chunks", "part", "seq", end.alias("rights"), "lefts"), "conversation-links")


def _handed_on(linked: DataFrame) -> DataFrame:
    """``linked`` with ``fresh``, the vector that the chunk after it has now."""
    after = linked.filter("at > 0").select("conv", (F.col("at") - 1).alias("at"), F.col("lefts").alias("fresh"))
    end = F.array(*[F.lit(int(v)).cast("long") for v in END])
    return linked.join(after, ["conv", "at"], "left").withColumn("fresh", F.coalesce("fresh", end))


def _settled(cut: DataFrame, linked: DataFrame, passes: int) -> DataFrame:
    """``linked`` with the true vector after every chunk."""
    out = linked.schema
    names = [f.name for f in out.fields]

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends, lengths = _flat(batch.column("codes"))
            fresh = _vectors(batch.column("fresh"))
            left = fixed_up(codes, ends, lengths, _vectors(batch.column("rights")), _vectors(batch.column("lefts")), fresh)
            columns = [_lists(fresh) if n == "rights" else _lists(left) if n == "lefts" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    done = linked.filter("chunks = 1")
    linked = linked.filter("chunks > 1")
    if linked.isEmpty():
        return done
    for _ in range(passes):
        state = written(_handed_on(linked), "conversation-pass")
        stale = state.filter("fresh != rights")
        if stale.isEmpty():
            return done.unionByName(linked)
        mended = stale.join(cut.select("part", "seq", "codes"), ["part", "seq"]).mapInArrow(rerun, out)
        linked = written(state.filter("fresh = rights").select(*names).unionByName(mended), "conversation-pass")
    if _handed_on(linked).filter("fresh != rights").isEmpty():
        return done.unionByName(linked)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends, lengths = _flat(batch.column("codes"))
            cells = np.empty((len(batch), 4, 4), np.int64)
            for state in range(4):
                right = np.full((len(batch), 4), FAR)
                right[:, state] = 0
                cells[:, :, state] = backward(codes, ends, lengths, right)[1]
            cells = np.minimum(cells - cells.min(axis=(1, 2), keepdims=True), FAR)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(cells.reshape(-1, 16))], ["conv", "at", "cells"])

    shape = f"conv {out['conv'].dataType.simpleString()}, at long, cells array<long>"
    cells = linked.join(cut.select("part", "seq", "codes"), ["part", "seq"]).select("conv", "at", "codes").mapInArrow(matrix, shape)
    products = _products(written(cells, "conversation-matrices"), towards=1)
    to_end = F.array(*[F.array_min(F.array(*[F.col("cells")[4 * i + j] + int(END[j]) for j in range(4)])) for i in range(4)])
    least = F.array_min("v")
    vector = products.select("conv", "at", to_end.alias("v")).select("conv", "at", F.transform("v", lambda x: x - least).alias("lefts"))
    exact = linked.drop("lefts").join(vector, ["conv", "at"]).select(*names)
    exact = _handed_on(written(exact, "conversation-vectors")).withColumn("rights", F.col("fresh")).select(*names)
    return done.unionByName(written(exact, "conversation-vectors"))


def _products(matrices: DataFrame, towards: int) -> DataFrame:
    """Min-plus products of each chunk's matrix with those of all chunks after it (``towards`` 1) or before it (-1).

    Doubling: every round joins a chunk with the one twice as far away, so there are as many rounds as the
    longest conversation's number of chunks has bits.
    """
    longest = matrices.agg(F.max("at")).first()[0]
    reach = 1
    while reach <= longest:
        other = matrices.select("conv", (F.col("at") - towards * reach).alias("at"), F.col("cells").alias("far"))
        first, second = ("cells", "far") if towards > 0 else ("far", "cells")
        cell = [
            F.least(F.lit(FAR), *[F.col(first)[4 * i + k] + F.col(second)[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)
        ]
        joined = matrices.join(other, ["conv", "at"], "left")
        cells = F.when(F.col("far").isNull(), F.col("cells")).otherwise(F.array(*cell))
        matrices = written(joined.select("conv", "at", cells.alias("cells")), "conversation-products")
        reach *= 2
    return matrices


def _entered(cut: DataFrame, settled: DataFrame) -> DataFrame:
    """part, seq, place, chunks, vector after the chunk and the state in which the cheapest edits enter it."""
    alone = settled.filter("chunks = 1").withColumn("entry", F.lit(START))
    long = settled.filter("chunks > 1")
    if long.isEmpty():
        return alone

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends, lengths = _flat(batch.column("codes"))
            right = _vectors(batch.column("rights"))
            before, _ = backward(codes, ends, lengths, right)
            cells = np.full((len(batch), 4, 4), FAR)
            for state in range(4):
                left = traced(codes, ends, lengths, before, right, np.full(len(batch), state))[1]
                cells[np.arange(len(batch)), state, left] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(cells.reshape(-1, 16))], ["conv", "at", "cells"])

    shape = f"conv {settled.schema['conv'].dataType.simpleString()}, at long, cells array<long>"
    own = long.join(cut.select("part", "seq", "codes"), ["part", "seq"]).select("conv", "at", "codes", "rights")
    products = _products(written(own.mapInArrow(moves, shape), "conversation-moves"), towards=-1)
    first = F.slice("cells", 1, 4)
    entries = products.select("conv", (F.col("at") + 1).alias("at"), (F.array_position(first, F.lit(0).cast("long")) - 1).cast("int").alias("entry"))
    entered = long.join(entries, ["conv", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    return alone.unionByName(written(entered, "conversation-entries"))


def repaired(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired rows) of ``rows`` (conv_id, turn, role, text, copies).

    The summary has a row a conversation: counts of faults (``blank``, ``duplicate``, ``truncated``),
    ``illegal``, ``gaps``, ``cost`` and ``audit``. The repaired rows (conv_id, at, place, side, role, text, edit) are in
    the order of (at, place, side). Rows are taken by turn, nulls first; those of one turn by role, then by
    the text's first ``PREFIX`` characters, then by a hash of the row, and a row's copies follow it at once.
    """
    coded = _coded(rows)
    cut = chunks(coded, chunk)
    entered = _entered(cut, _settled(cut, _linked(cut), passes))
    work = entered.select("part", "seq", "at", "chunks", "rights", "entry")
    schema = (
        f"conv_id {coded.schema['conv_id'].dataType.simpleString()}, at long, audit string, cost long, blank long, duplicate long, "
        "truncated long, illegal long, head int, tail int, "
        "edits array<struct<row:binary,place:int,side:int,role:string,edit:string>>"
    )
    edit_type = pa.list_(pa.struct([("row", pa.binary()), ("place", pa.int32()), ("side", pa.int32()), ("role", pa.string()), ("edit", pa.string())]))
    legal = np.zeros((4, 4), bool)
    for pair in LEGAL:
        legal[pair] = True

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes, ends, lengths = _flat(batch.column("codes"))
            starts, entry = ends - lengths, batch.column("entry").to_numpy()
            copies = batch.column("copies").flatten().to_numpy()
            right = _vectors(batch.column("rights"))
            before, _ = backward(codes, ends, lengths, right)
            edits, _ = traced(codes, ends, lengths, before, right, entry)
            role, fault = codes >> 2, codes & 3
            cost = PRICES[edits] + DELETE * (copies - 1) + np.where((edits > 0) & (fault == CUT_OFF), TRUNCATED, 0)
            blank = np.where(fault == BLANK, copies, 0)
            again = np.where(fault == DUPLICATE, copies, np.where(fault == BLANK, 0, copies - 1))
            wrong = copies - 1
            wrong[1:] += ~legal[role[:-1], role[1:]]
            wrong[starts] = copies[starts] - 1
            cost, *faults = (np.add.reduceat(x, starts) for x in (cost, blank, again, (fault == CUT_OFF).astype(np.int64), wrong))
            last = batch.column("at").to_numpy() + 1 == batch.column("chunks").to_numpy()
            ids, roles = batch.column("rows").flatten().to_pylist(), batch.column("roles").flatten().to_pylist()
            audits, lists = [], []
            for c, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                audit, out, state = _written_out(edits[a:b], role[a:b], copies[a:b], ids[a:b], roles[a:b], int(entry[c]))
                if last[c]:
                    audit += TAILS[state]
                    cost[c] += INSERT * len(TAILS[state])
                    for i in range(len(TAILS[state])):
                        out.append((None, b - a, i, NAMES[state], "I"))
                        state = int(INSERTED[state])
                audits.append(audit)
                lists.append(out)
            names = ("row", "place", "side", "role", "edit")
            lists = pa.array([[dict(zip(names, e)) for e in out] for out in lists], edit_type)
            ends_of = [pa.array(role[x].astype(np.int32)) for x in (starts, ends - 1)]
            columns = [batch.column("conv_id"), batch.column("at"), pa.array(audits, pa.string()), *map(pa.array, (cost, *faults)), *ends_of, lists]
            yield pa.RecordBatch.from_arrays(columns, [n.split()[0] for n in schema.split(", ")])

    joined = work.join(cut.select("conv_id", "part", "seq", "codes", "copies", "rows", "roles"), ["part", "seq"])
    result = written(joined.mapInArrow(edited, schema), "conversation-edits")
    summary = _summary(coded, result)
    edits = result.select("conv_id", "at", F.explode("edits").alias("e")).select("conv_id", "at", "e.*")
    texts = _keyed(rows).groupBy("row").agg(F.first("text").alias("text"))
    kept = edits.filter("row IS NOT NULL").join(texts, "row").select("conv_id", "at", "place", "side", "role", "text", "edit")
    made = edits.filter("row IS NULL").select("conv_id", "at", "place", "side", "role", F.lit("").alias("text"), "edit")
    return summary, kept.unionByName(made)


def _written_out(edits, role, copies, ids, roles, state: int) -> tuple[str, list[tuple], int]:
    """The audit of a chunk's rows, what they leave (row, place, side, role, edit) and the state after them."""
    letters, out = [], []
    for i, (e, r, n) in enumerate(zip(edits.tolist(), role.tolist(), copies.tolist())):
        letters.append(LETTERS[e])
        if n > 1:
            letters.append("D" * (n - 1))
        if e == 0:
            continue
        if e > 2:
            out.append((None, i, 0, NAMES[state], "I"))
            state = int(INSERTED[state])
        keep = e % 2 == 1
        out.append((ids[i], i, 1, roles[i] if keep else NAMES[state], "K" if keep else "R"))
        state = SYSTEM if keep and r == 0 else int(INSERTED[state])
    return "".join(letters), out, state


def _summary(coded: DataFrame, result: DataFrame) -> DataFrame:
    key = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id").alias("conv")
    turns = coded.groupBy(key, "turn").agg(F.lit(1).alias("one"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    spans = turns.groupBy("conv").agg(gaps.alias("gaps"))
    own = result.select(key, *[c for c in result.columns if c not in ("edits", "conv_id")])
    faults = ("blank", "duplicate", "truncated", "illegal", "cost")
    pieces = F.array_sort(F.collect_list(F.struct("at", "audit", "head", "tail")))
    whole = own.groupBy("conv").agg(*[F.sum(c).alias(c) for c in faults], pieces.alias("pieces"))
    pairs = F.zip_with(F.slice("pieces", 1, F.size("pieces") - 1), F.slice("pieces", 2, F.size("pieces")), _crossing)
    illegal = F.col("illegal") + F.when(F.size("pieces") > 1, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(0)
    audit = F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit")
    return whole.withColumn("illegal", illegal).join(spans, "conv").select("conv", "gaps", *faults, audit)


def _crossing(a: Column, b: Column) -> Column:
    legal = F.lit(False)
    for x, y in sorted(LEGAL):
        legal = legal | (a["tail"] == x) & (b["head"] == y)
    return F.when(legal, 0).otherwise(1).cast("long")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the rows' ``role:text``, joined by newlines.

    The digest runs through a conversation's bytes in order, so each conversation is read by one task; rows
    stream through it, sorted on disk, and no text is kept.
    """
    kind = repaired_rows.schema["conv_id"].dataType.simpleString()
    rows = repaired_rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at", "place", "side")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, ids, found, kind_of = None, None, [], [], None
        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or own != conv:
                    if state is not None:
                        ids.append(conv)
                        found.append(state.hexdigest())
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
                ids, found = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_of), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "role", "text").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for every conv_id of ``conversations``: the damage found in it and its cheapest repair.

    Rows are damaged first (``damaged``). A null role, text, conv_id or turn counts as one space there; a null
    conv_id is a conversation of its own, and a null turn comes first and leaves no gap. Rows that are equal in
    all four columns are copies that follow each other. A conversation without rows after the damage has
    zeros, an empty audit and the hash of the empty string; so has one whose rows all go. An empty table gives
    no row. Other columns are ignored, whatever their names.
    """
    rows = damaged(conversations)
    summary, after = repaired(rows)
    key = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id").alias("conv")
    hashed = digests(after).select(key, "repaired_sha256")
    every = conversations.select(key).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = every.join(summary, "conv", "left").join(hashed, "conv", "left")
    return out.select(
        F.col("conv.conv_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
