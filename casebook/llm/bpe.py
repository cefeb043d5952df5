"""Byte-pair encoding and decoding in batched array rounds.

The symbols of many distinct words lie in one flat array. A round looks up every neighbouring pair by
binary search over the sorted pair keys, finds each word's lowest rank, and merges that pair wherever
it stands in the word, from left to right. Words without a pair leave the array.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import in_slices, record, whole_text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Texts of these characters are split here; others by the tokenizer file's own normalizer and splitter.
SIMPLE = re.compile(r"[\x00-\xff‐-‧‰-⁞€]*")
#: Contractions, runs of letters, single digits and runs of other marks, over simple texts in lower case.
LETTERS, NUMBERS, WHITE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+")
NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class BytePairs:
    """Merge tables of a tokenizer file: vocabulary, sorted pair keys, and rank and product of each pair."""

    def __init__(self, tokenizer_json: str, most: int = 250_000):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.products = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        signs = byte_characters()
        self.inner = np.array([vocabulary[c] for c in signs], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in signs], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in (vocabulary | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.splitter = Tokenizer.from_str(tokenizer_json)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.back = {c: b for b, c in enumerate(signs)}
        self.known: dict[bytes | str, list[int]] = {}
        self.most = most

    def merge(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of words given as bytes, none of them empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            same = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(same, self.ranks[at], NONE), NONE)
            opens = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
            best = np.minimum.reduceat(rank, opens)
            spread = np.repeat(best, np.diff(np.append(opens, len(symbols))))
            live = spread < NONE
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, rank, spread = symbols[live], word[live], rank[live], spread[live]
                at = np.append(at, 0)[live]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            hit = np.flatnonzero(rank == spread)
            run = np.concatenate(([True], np.diff(hit) != 1))  # hits one after the other are one symbol repeated
            first = np.maximum.accumulate(np.where(run, hit, 0))
            hit = hit[(hit - first) % 2 == 0]
            symbols[hit] = self.products[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        cuts = np.cumsum(np.bincount(word, minlength=len(words)))[:-1]
        return [x.tolist() for x in np.split(symbols[order], cuts)]

    def words(self, text: str) -> list[str | bytes | int]:
        """The words of a text, or the id of a special token that stands in it."""
        if self.cut is not None and "<" in text:
            out: list[str | bytes | int] = []
            for i, part in enumerate(self.cut.split(text)):
                out.extend([self.special[part]] if i % 2 else self._plain_words(part))
            return out
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str | bytes]:
        if SIMPLE.fullmatch(text):
            return WORDS.findall(text.lower())
        split = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text))
        return [bytes(self.back[c] for c in word) for word, _ in split if word]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        rows = [self.words(t) for t in texts]
        flat = list(chain.from_iterable(rows))
        found = list(map(self.known.get, flat))
        if None in found:
            new = list({w for w, ids in zip(flat, found) if ids is None and not isinstance(w, int)})
            merged = self.merge([w if isinstance(w, bytes) else w.encode("utf-8") for w in new]) if new else []
            fresh = dict(zip(new, merged))
            found = [([w] if isinstance(w, int) else fresh[w]) if ids is None else ids for w, ids in zip(flat, found)]
            if len(self.known) + len(fresh) > self.most:
                self.known = {}
            if len(fresh) <= self.most:
                self.known.update(fresh)
        out, at = [], 0
        for row in rows:
            out.append(list(chain.from_iterable(found[at : at + len(row)])))
            at += len(row)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Token names with a space between them, as a tokenizer file without a decoder has it; unknown ids give nothing."""
        names = self.names
        return " ".join([names[i] for i in ids if 0 <= i < len(names) and names[i]])


@lru_cache(maxsize=1)
def byte_pairs(tokenizer_json: str) -> BytePairs:
    """One table a Python worker, kept between its tasks."""
    return BytePairs(tokenizer_json)


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row's whole text.

    Null texts count as empty and give an empty array. Repeated rows and null ids get a row each. An
    empty table gives no row. Other columns are ignored, whatever their names.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_pairs(vocabulary.value)
        for rows, texts in in_slices(batches):
            yield record(schema, rows.column("doc_id"), table.encode(texts))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(coded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, ``ids`` and ``decoded`` text of every row of ``encoded``; null ids count as none."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_pairs(vocabulary.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [table.decode(ids or ()) for ids in part.column("ids").to_pylist()]
                yield record(schema, part.column("doc_id"), part.column("ids"), out)

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, ids array<int>, decoded string")
