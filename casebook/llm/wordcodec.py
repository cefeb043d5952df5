"""Tokenizer library calls on distinct text runs.

A byte-level tokenizer with the usual split pattern never joins characters across the point where a
white-space run starts, around a lone line feed, or between a Latin letter and one of a few marks.
Texts are cut there, the library encodes each distinct run once, and the ids are put together again.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

#: Unicode's White_Space, as the split pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters of the first Latin blocks, and marks that are neither letters, digits nor quotes.
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
MARKS = r".,;:!?&$*#%\-()"
RUNS = re.compile(f"\\n(?=[^{SPACE}])|[{SPACE}]*+[{LATIN}]++(?=[{SPACE}{MARKS}]|\\Z)|[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++")
#: Runs that may share one library call: a line feed between them stays a token of its own.
PLAIN = re.compile(f" ?[^{SPACE}]+")
TOGETHER = 256
#: Runs that the usual split pattern leaves in one piece, which the library's model can take without the steps around it.
WORD = re.compile(f" ?[{LATIN}]+")


def load(tokenizer_json: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def one_piece(tokenizer_json: str) -> bool:
    """Whether the library does no more with a run of ``WORD`` than to split it into bytes and apply its merges."""
    given = json.loads(tokenizer_json)
    cut = given["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    inside = re.compile(f" ?[{LATIN}]*")
    added = any(inside.fullmatch(t["content"]) for t in given["added_tokens"])
    return given["model"]["type"] == "BPE" and given["normalizer"] is None and plain and not added


def byte_letters() -> dict[int, str]:
    """For every character of ``WORD`` the letters that stand for its bytes in a byte-level vocabulary."""
    split = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {ord(c): split(c)[0][0] for c in map(chr, range(256)) if c == " " or WORD.fullmatch(c)}


class RunEncoder:
    """Token ids of whole texts; ``most`` bounds the runs remembered between texts."""

    def __init__(self, tokenizer_json: str, most: int = 400_000):
        self.tokenizer = load(tokenizer_json)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.model = self.tokenizer.model if one_piece(tokenizer_json) else None
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}  # ids of a run, four bytes each
        self.most = most

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, runs: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if self.model is not None:
            word, merged, letters = WORD.fullmatch, self.model.tokenize, self.letters
            out = {run: array("I", [token.id for token in merged(run.translate(letters))]).tobytes() for run in runs if word(run)}
            runs = [run for run in runs if run not in out]
        whole = PLAIN.fullmatch
        plain = [run for run in runs if whole(run)] if len(self.feed) == 1 else []
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for i in range(0, len(groups), 64):
            part = groups[i : i + 64]
            for group, ids in zip(part, self._library(["\n".join(g) for g in part])):
                ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids)) * 4
                if len(ends) == len(group):
                    raw, opens = ids.tobytes(), np.append(0, ends[:-1] + 4)
                    out.update(zip(group, [raw[a:b] for a, b in zip(opens.tolist(), ends.tolist())]))
        rest = [run for run in runs if run not in out]
        for i in range(0, len(rest), 4096):
            out.update(zip(rest[i : i + 4096], [ids.tobytes() for ids in self._library(rest[i : i + 4096])]))
        return out

    def _ids_of(self, runs: list[str]) -> list[bytes]:
        found = list(map(self.known.get, runs))
        if None in found:
            fresh = self._new(list(dict.fromkeys(run for run, ids in zip(runs, found) if ids is None)))
            found = [fresh[run] if ids is None else ids for run, ids in zip(runs, found)]
            if len(self.known) + len(fresh) > self.most:
                self.known = {}
            if len(fresh) <= self.most:
                self.known.update(fresh)
        return found

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """One array of ids (unsigned, 32 bits) a text. Each run is looked up once, however often the texts have it."""
        runs = [RUNS.findall(text) for text in texts]
        ends = np.cumsum([0, *map(len, runs)])
        coded = pa.array(list(chain.from_iterable(runs)), pa.large_string()).dictionary_encode()
        del runs
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = pa.array(self._ids_of(distinct), pa.large_binary())
        _, offsets, data = found.take(coded.indices).buffers()
        if not data:
            return [np.zeros(0, np.uint32) for _ in texts]
        at = np.frombuffer(offsets, np.int64)[ends] // 4
        ids = np.frombuffer(data, np.uint32, int(at[-1]))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> RunEncoder:
    """One encoder a Python worker, kept between its tasks."""
    return RunEncoder(tokenizer_json)
