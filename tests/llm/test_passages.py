"""Suffix orders against sorting, and removed passages against a table of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from casebook.llm import passages
from casebook.llm.common import table
from casebook.llm.suffixes import suffix_order
from tests.llm import corpus


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    assert suffix_order([]) == []
    for _ in range(1500):
        text = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(1, 40))]
        assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])
    long = ([3, 1, 2, 1] * 300) + [1] * 500 + list(range(200, 0, -1))
    assert suffix_order(long) == sorted(range(len(long)), key=lambda i: long[i:])


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text) rows, from the smallest id of every string."""
    first = {}
    for doc_id, text in rows:
        data, own = (text or "").encode(), passages.NO_ID if doc_id is None else doc_id
        for i in range(len(data) - 49):
            s = data[i : i + 50]
            first[s] = min(own, first.get(s, own))
    out = []
    for doc_id, text in rows:
        data, own = (text or "").encode(), passages.NO_ID if doc_id is None else doc_id
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < own:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def check(docs, **options):
    want = order(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert order([tuple(r) for r in passages.without_passages(docs, **options).collect()]) == want
    return want


def cut_up(rng, n=60):
    """Texts that share passages of 30 to 300 bytes at any place, some of them edited."""
    passage = [corpus.prose(rng, rng.randint(6, 60)) for _ in range(12)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passage) if rng.random() < 0.6 else corpus.prose(rng, 8)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : rng.randint(a, len(p))])
        out.append(("" if rng.random() < 0.5 else " ").join(parts))
    return out + [out[3] + "x", out[3], out[4], "é" * 40 + out[5], "ab" * 200, "ab" * 30 + "c" + "ab" * 60, "a" * 49, "a" * 50, "a" * 51]


def test_passages_equal_brute_force(spark):
    rng = random.Random(2)
    want = check(corpus.documents(spark, cut_up(rng)))
    assert sum(r[2] > 0 for r in want) > 20 and any(r[3] > 1 for r in want)


def test_odd_repeated_and_null_rows(spark):
    check(corpus.mixed(spark))
    assert passages.without_passages(corpus.empty(spark)).count() == 0
    short = spark.createDataFrame([(1, "short"), (2, None), (None, "short")], "doc_id long, text string")
    check(short)


@pytest.mark.parametrize("crowd", [20_000, 3, 0])
def test_many_slices_buckets_and_hot_grams(spark, monkeypatch, crowd):
    """Slices of a few texts and several sorting tasks; some or all grams too frequent for one task."""
    monkeypatch.setattr(passages, "SLICE", 3000)
    monkeypatch.setattr(passages, "GRAMS", 300)
    monkeypatch.setattr(passages, "CONTEXTS", 100)
    strings, called = passages._compared_strings, []
    monkeypatch.setattr(passages, "_compared_strings", lambda *a: called.append(1) or strings(*a))
    check(corpus.documents(spark, cut_up(random.Random(3), 120)), crowd=crowd)
    assert bool(called) == (crowd < 64)


def test_blocks_cut_anchors_alike():
    data = np.frombuffer((corpus.prose(random.Random(4), 3000)).encode(), np.uint8)
    ends = np.array([100, 140, 5000, len(data)])
    _, _, text, low, place, high = passages.anchors(data, ends)
    begins = np.concatenate(([0], ends[:-1]))
    assert (low >= begins[text]).all() and (high <= ends[text]).all() and ((place >= low) & (place + 25 <= low + 50)).all()
    covered = np.concatenate([np.arange(a, b - 49) for a, b in zip(low, high)])
    want = np.concatenate([np.arange(a, max(a, b - 49)) for a, b in zip(begins, ends)])
    assert np.array_equal(np.sort(covered), want)


def test_shared_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(docs)


def test_sides_cover_every_string():
    """Any split of the 25 bytes beside a gram has the sides of one pair."""
    assert all(any(a <= left and b <= 25 - left for a, b in passages.SIDES) for left in range(26))
