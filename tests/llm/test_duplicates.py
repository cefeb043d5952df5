"""Exact and near duplicates and licence scans by brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from casebook.llm import components, exact, licenses, simhash
from tests.llm import corpus


def brute_exact(rows):
    groups = defaultdict(list)
    clean = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows]
    for r, c in zip(rows, clean):
        groups[c].append((-len(r.text or ""), (r.doc_id is not None, r.doc_id or 0), r.doc_id))
    out = []
    for r, c in zip(rows, clean):
        size, _, keep = min(groups[c])
        kept = keep == r.doc_id and -size == len(r.text or "")
        out.append((r.doc_id, keep, len(groups[c]), kept, hashlib.sha256(c.encode()).hexdigest()))
    return Counter(out)


def test_exact_groups(spark):
    for docs in (corpus.mixed(spark), corpus.empty(spark)):
        got = Counter(tuple(r) for r in exact.exact_groups(docs).collect())
        assert got == brute_exact(docs.select("doc_id", "text").collect())


def test_chunks_that_share_an_identifier_are_told_apart(spark):
    docs = corpus.documents(spark)
    drawn = []

    def poor(chunk, draw):
        drawn.append(draw)
        return F.xxhash64(chunk) % 3 if draw < 2 else exact.chunk_id(chunk, draw)

    got = Counter(tuple(r) for r in exact.exact_groups(docs, poor).collect())
    assert got == brute_exact(docs.select("doc_id", "text").collect()) and set(drawn) == {0, 1, 2}


def test_chunks_cover_the_text_and_follow_the_content(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz.é日😀") for _ in range(60_000))
    frame = spark.createDataFrame([(text,), ("junk" + text,), ("z" * 30_000,), ("",)], "t string")
    a, b, z, nothing = (r[0] for r in frame.select(exact.chunks(F.col("t"))).collect())
    assert "".join(a) == text and "".join(z) == "z" * 30_000 and nothing == []
    assert max(map(len, a + z)) <= exact.LONGEST and len(set(a) & set(b)) > len(a) * 0.8


def test_exact_copies_leave_one(spark):
    docs = corpus.documents(spark)
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    kept = {k[0] for k in brute_exact(docs.collect()) if k[3]}
    assert {r.doc_id for r in left.collect()} == kept
    assert exact.without_copies(corpus.empty(spark)).count() == 0


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(prints):
    """Class of each fingerprint: the smallest one that links of at most four bits reach."""
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def brute_near(rows, fingerprint=brute_fingerprint):
    prints = [fingerprint(r.text) for r in rows]
    root = brute_components(sorted(set(prints)))
    ids = defaultdict(list)
    for r, p in zip(rows, prints):
        ids[root[p]].append(r.doc_id)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((r.doc_id, f"{p:016x}", least[root[p]]) for r, p in zip(rows, prints))


def test_near_groups(spark):
    for docs in (corpus.mixed(spark), corpus.empty(spark)):
        got = Counter(tuple(r) for r in simhash.near_groups(docs).collect())
        assert got == brute_near(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("crowd, block", [(256, 1024), (2, 3), (1, 1)])
def test_links_connect_all_that_is_near(spark, crowd, block):
    """Chains and dense balls of fingerprints, by joins and by blocks."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(prints)[:4]:
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    chain = 0
    for i in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(chain)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long"), crowd, block)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in pairs)
    got = {r.node: r.root for r in components.components(found).collect()}
    want = brute_components(sorted(prints))
    classes = defaultdict(set)
    for p, s in zip(prints, signed):
        classes[want[p]].add(got.get(s, s))
    assert all(len(c) == 1 for c in classes.values()) and len(set.union(*classes.values())) == len(classes)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_near_group_stays(spark):
    docs = corpus.documents(spark)
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns
    want = {k[2] for k in brute_near(docs.collect())}
    assert {r.doc_id for r in left.collect()} == want
    assert simhash.without_near_copies(corpus.empty(spark)).count() == 0


def keyed(spark, rows):
    return spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, __n string")


def test_one_row_of_each_exact_group_stays_without_or_with_shared_ids(spark):
    rows = [(None, "a b c"), (None, "abc"), (None, "a bc"), (None, None), (None, ""), (1, "x y"), (1, "x y"), (1, "x  y"), (1, "other"), (2, "xy"), (3, "k l"), (3, "kl ")]
    left = exact.without_copies(keyed(spark, rows)).collect()
    assert sorted((r.text or "").replace(" ", "") for r in left) == ["", "abc", "kl", "other", "xy"]
    assert all(rows[int(r["__n"])] == (r.doc_id, r.text) for r in left)
    assert [(r.doc_id, r.text) for r in left if r.text and "y" in r.text] == [(1, "x  y")]


def test_one_row_of_each_near_group_stays_without_or_with_shared_ids(spark):
    rng = random.Random(3)
    text, unlike, third = (" ".join(str(rng.random()) for _ in range(200)) for _ in range(3))
    near = text.replace(" ", "  ")
    rows = [(1, text), (1, text), (2, near), (2, unlike), (None, near), (None, third), (None, third), (None, third + " ")]
    left = simhash.without_near_copies(keyed(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text.strip()) for r in left) == sorted([("1", text), ("2", unlike), ("None", third)])


def brute_scan(rows):
    out = []
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = {}
        for t in licenses.TEMPLATES:
            p = t.phrase.split()
            places[t] = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        base = sorted(i for t, own in places.items() if t.base for i in own)
        label = lambda base_only: ",".join(sorted({t.label for t, own in places.items() if own and (t.base or not base_only)}))
        total = sum(map(len, places.values()))
        first, last = (base[0], base[-1]) if base else (None, None)
        out.append((r.doc_id, len(words), len(base), first, last, label(True), label(False), 1 - 0.5**total))
    return Counter(out)


def test_license_scan(spark):
    extra = [
        "under the MIT license under the mit license, under the mit",
        "Apache License, Version 2.0; cc by nc cc-by-nc-sa CC BY SA",
        "Permission is hereby granted, free of charge, to any person obtaining a copy (MIT)",
        "GNU Lesser General Public License and Kelvin mİt",
        "mit license under the",
    ]
    docs = corpus.mixed(spark).union(corpus.documents(spark, extra))
    got = Counter(tuple(r) for r in licenses.scan(docs).collect())
    assert got == brute_scan(docs.select("doc_id", "text").collect())
    assert licenses.scan(corpus.empty(spark)).count() == 0


def test_rarest_words_are_looked_up():
    idf = {"under": 1.0, "the": 0.1, "mit": 3.0, "license": 2.0}
    assert licenses.anchors(licenses.Template("mit", "under the mit license"), idf) == [("mit", 2), ("license", 3)]
