"""Token counts of sections from one encoding of the whole document.

A document is encoded once, with the place of every token in it. Sections are spans of characters that
cover the text; a binary search joins tokens to sections. The rule for a token that reaches over a
border: it belongs to the section that holds its first character other than white space, or its first
character if it has no other. So every token counts once, and a document's sections sum to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import in_slices, record, whole_text
from casebook.llm.wordcodec import PLAIN, RUNS, TOGETHER, RunEncoder

#: A section ends behind a line feed, or behind a mark that ends a sentence and before white space.
BORDER = r"\n|[.!?](?=\s)"
COUNTS = "doc_id long, section int, start int, n_chars int, n_tokens int, doc_tokens long"


class PlaceEncoder(RunEncoder):
    """Of every token, the character by which it is attributed, counted from its run's start."""

    def _library(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for text, coded in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            places = [_first(text, a, b) for a, b in coded.offsets]
            out.append((np.array(coded.ids, np.uint32), np.array(places, np.uint32)))
        return out

    def _new(self, runs: list[str]) -> dict[str, bytes]:
        whole = PLAIN.fullmatch
        plain = [run for run in runs if whole(run)] if len(self.feed) == 1 else []
        out: dict[str, bytes] = {}
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for i in range(0, len(groups), 64):
            part = groups[i : i + 64]
            for group, (ids, places) in zip(part, self._library(["\n".join(g) for g in part])):
                ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids))
                if len(ends) != len(group):
                    continue
                opens = np.append(0, ends[:-1] + 1)
                begins = np.cumsum([0, *(len(run) + 1 for run in group[:-1])])
                raw = (places - np.repeat(begins, np.diff(np.append(opens, len(ids))))).astype(np.uint32).tobytes()
                out.update(zip(group, [raw[4 * a : 4 * b] for a, b in zip(opens.tolist(), ends.tolist())]))
        rest = [run for run in runs if run not in out]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            out.update(zip(part, [places.tobytes() for _, places in self._library(part)]))
        return out

    def places(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each text, the ascending places of its tokens."""
        runs = [RUNS.findall(text) for text in texts]
        found = self._ids_of(list(chain.from_iterable(runs)))
        out, at = [], 0
        for own in runs:
            part = found[at : at + len(own)]
            at += len(own)
            begins = np.cumsum(np.fromiter(chain((0,), map(len, own)), np.int64, len(own) + 1))[:-1]
            tokens = np.fromiter(map(len, part), np.int64, len(part)) // 4
            out.append(np.frombuffer(b"".join(part), np.uint32) + np.repeat(begins, tokens))
        return out


def _first(text: str, start: int, end: int) -> int:
    at = start
    while at < end and text[at].isspace():
        at += 1
    return at if at < end else start


@lru_cache(maxsize=1)
def place_encoder(tokenizer_json: str) -> PlaceEncoder:
    return PlaceEncoder(tokenizer_json, most=400_000)


def sections(text: str, border: re.Pattern) -> np.ndarray:
    """Starts of the sections of a text; a text without a border, or an empty one, is one section."""
    starts = [0, *(m.end() for m in border.finditer(text) if m.end() < len(text))]
    return np.array(starts, np.int64)


def section_tokens(docs: DataFrame, tokenizer_json: str, border: str = BORDER) -> DataFrame:
    """A row a section: doc_id, section (from 0), start, n_chars, n_tokens and doc_tokens.

    Null texts count as empty and have one section without tokens. Repeated rows and null ids get rows
    of their own. An empty table gives no row. Other columns are ignored, whatever their names.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(("doc_id", "section", "start", "n_chars", "n_tokens", "doc_tokens"), kinds)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, cut = place_encoder(vocabulary.value), re.compile(border)
        for rows, texts in in_slices(batches):
            starts = [sections(t, cut) for t in texts]
            places = code.places(texts)
            tokens = [np.bincount(np.searchsorted(s, p, side="right") - 1, minlength=len(s)) for s, p in zip(starts, places)]
            each = np.array([len(s) for s in starts])
            chars = [np.diff(np.append(s, len(t))) for s, t in zip(starts, texts)]
            row = pa.array(np.repeat(np.arange(len(texts)), each), pa.int64())
            number = np.concatenate([np.arange(n) for n in each])
            total = np.repeat(np.array([len(p) for p in places], np.int64), each)
            yield record(schema, rows.column("doc_id").take(row), number, np.concatenate(starts), np.concatenate(chars), np.concatenate(tokens), total)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(counted, COUNTS)
