"""Token store, packing, byte pairs and section counts against the library."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from casebook.llm import bpe, packing, perfecthash, tokencount, tokenstore
from casebook.llm.wordcodec import RunEncoder, one_piece
from tests.llm import corpus

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    signs = list("aAbsStTlL'’ \n\tÀéßİıΣςK²½x1٣日語テ😀.,-–…“!?<|>́\x1c\x85  ﬁaannnhhe") + ["<|endoftext|>", "'re", "'LL", "  "]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def library_ids(name, texts):
    return [x.ids for x in corpus.tokenizer(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_run_encoder_is_the_library():
    texts = odd_texts(4000) + [t or "" for t in corpus.texts()]
    for most in (600_000, 3):
        got = RunEncoder(corpus.vocabulary(BYTE), most).encode(texts)
        assert [x.tolist() for x in got] == library_ids(BYTE, texts)


def test_run_encoder_looks_up_a_run_once_and_merges_words_alone():
    class Counted(RunEncoder):
        asked, whole = [], []

        def _ids_of(self, runs):
            self.asked += runs
            return super()._ids_of(runs)

        def _library(self, texts):
            self.whole += texts
            return super()._library(texts)

    texts = ["the cat, the cat\n" * 50, "Größe the cat", "", "x2 the"]
    code = Counted(corpus.vocabulary(BYTE))
    assert [x.tolist() for x in code.encode(texts)] == library_ids(BYTE, texts)
    assert len(code.asked) == len(set(code.asked)) and {" the", " cat", "Größe"} <= set(code.asked)
    assert not any("the" in t or "Größe" in t for t in code.whole) and any("x2" in t for t in code.whole)


def test_words_go_through_the_whole_library_if_it_does_more_with_them():
    given = json.loads(corpus.vocabulary(BYTE))
    assert one_piece(json.dumps(given))
    assert not one_piece(json.dumps(given | {"normalizer": {"type": "Lowercase"}}))
    assert not one_piece(json.dumps(given | {"pre_tokenizer": given["pre_tokenizer"] | {"add_prefix_space": True}}))
    added = given["added_tokens"] + [given["added_tokens"][0] | {"id": 50257, "content": "cat"}]
    assert not one_piece(json.dumps(given | {"added_tokens": added}))
    texts = ["the cat sat", "cats"]
    own = json.dumps(given | {"added_tokens": added})
    want = [x.ids for x in Tokenizer.from_str(own).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in RunEncoder(own).encode(texts)] == want


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False).astype(np.int64) - 10**6
    index = perfecthash.KeyIndex.load(perfecthash.KeyIndex.build(keys, np.column_stack((keys, keys * 2))).dump())
    assert sorted(index.hashing.slots(keys)) == list(range(n))
    found, values = index.find(keys)
    assert found.all() and (values[:, 0] == keys).all()
    assert not index.find(np.arange(-(10**9), -(10**9) + 500))[0].any()


def test_store_round_trip(spark):
    docs = corpus.mixed(spark)
    store = tokenstore.write_store(docs, corpus.vocabulary(BYTE), end_id=2)
    rows = tokenstore.read_rows(store, tokenstore.stored_rows(store, docs)).collect()
    source = docs.select("doc_id", "text").collect()
    ids = [[*x, 2] for x in library_ids(BYTE, [r.text for r in source])]
    want = Counter((r.doc_id, np.array(x, "<u4").tobytes()) for r, x in zip(source, ids))
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys) and all(4 * r.n_tokens == len(r.ids) for r in rows)
    strangers = spark.createDataFrame([(10**9,), (None,)], "doc_id long")
    assert tokenstore.look_up(store, strangers).count() == 0


def test_uncommitted_payload_is_ignored(spark):
    store = tokenstore.write_store(corpus.documents(spark), corpus.vocabulary(BYTE), end_id=2)
    with tokenstore.opened(f"{store.path}/payload/shard-00000000-lost.bin", write=True) as f:
        f.write(b"\0" * 999)
    rows = tokenstore.read_rows(store, tokenstore.stored_rows(store, corpus.documents(spark)))
    assert rows.count() == len(corpus.texts())


def test_few_keys_in_many_buckets(spark, monkeypatch):
    """One document in many rows: most buckets have no key."""
    monkeypatch.setattr(tokenstore, "KEYS_A_BUCKET", 2)
    docs = spark.createDataFrame([(5 if i % 3 else i, f"text {i % 4}") for i in range(60)], "doc_id long, text string")
    store = tokenstore.write_store(docs, corpus.vocabulary(BYTE), end_id=2)
    rows = tokenstore.read_rows(store, tokenstore.stored_rows(store, docs)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())


def test_store_of_nothing(spark):
    docs = corpus.empty(spark)
    store = tokenstore.write_store(docs, corpus.vocabulary(BYTE), end_id=2)
    assert tokenstore.read_rows(store, tokenstore.stored_rows(store, docs)).count() == 0


def check_packing(rows, texts, capacity):
    ids = {i: np.array([*x, 0], "<u4") for i, x in zip(texts, library_ids(BYTE, list(texts.values())))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert np.array_equal(np.frombuffer(r.ids, "<u4"), ids[r.doc_id][r.start : r.start + r.length])
        assert 0 < r.length <= capacity and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own, total in [(pieces[i], len(x)) for i, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == total if total is not None else at <= capacity
    return [sum(n for _, n in s) for s in sequences.values()]


@pytest.mark.parametrize("capacity", [7, 1024])
def test_packing_keeps_every_id_once(spark, capacity):
    docs = corpus.documents(spark)
    rows = packing.pack(docs, corpus.vocabulary(BYTE), end_id=0, capacity=capacity, docs_a_group=8).collect()
    fills = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, capacity)
    assert sum(f < capacity for f in fills) <= 8  # at most one open sequence a group


def test_packing_of_repeated_rows_and_nothing(spark):
    docs = corpus.mixed(spark)
    rows = packing.pack(docs, corpus.vocabulary(BYTE), end_id=0)
    total = sum(len(x) + 1 for x in library_ids(BYTE, [r.text for r in docs.collect()]))
    assert rows.agg({"length": "sum"}).first()[0] == total
    assert packing.pack(corpus.empty(spark), corpus.vocabulary(BYTE), end_id=0).count() == 0


def test_first_fit_decreasing_against_plain_search():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 333):
        sizes = np.array([rng.randint(1, 100) for _ in range(n)], np.int64)
        room, want = [], np.zeros(n, np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            want[i] = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            if want[i] == len(room):
                room.append(100)
            room[want[i]] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100).tolist() == want.tolist()


def test_byte_pairs_are_the_library():
    texts = odd_texts(4000) + [t or "" for t in corpus.texts()]
    table, library = bpe.BytePairs(corpus.vocabulary(WORD), most=50), corpus.tokenizer(WORD)
    got = table.encode(texts)
    assert got == library_ids(WORD, texts)
    assert [table.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]
    assert table.decode([10**7, -1]) == ""


def test_byte_pair_frames(spark):
    docs, vocabulary = corpus.mixed(spark), corpus.vocabulary(WORD)
    rows = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    source = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, tuple(x)) for r, x in zip(source, library_ids(WORD, [r.text for r in source])))
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert bpe.decode(bpe.encode(corpus.empty(spark), vocabulary), vocabulary).count() == 0


def test_op6_digests(spark):
    from casebook.llm.queries import QUERIES

    root, library = "/root/testdata/sf0.001", corpus.tokenizer(WORD)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    for r in QUERIES["op6_bpe"](spark, root).collect():
        ids = library.encode(source[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(" ".join(map(str, ids)))
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


def test_op1_and_op2_digests(spark):
    from casebook.llm.queries import QUERIES

    root = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    coded = dict(zip(source, library_ids(BYTE, list(source.values()))))
    at = 0
    for r in sorted(QUERIES["op1_token_store"](spark, root).collect()):
        ids = [*coded[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = QUERIES["op2_packing"](spark, root).collect()
    for r in rows:
        part = np.array([*coded[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in coded.values())


def brute_sections(text, library, border):
    starts = [0, *(m.end() for m in re.finditer(border, text) if m.end() < len(text))]
    counts = [0] * len(starts)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        inside = [i for i in range(a, b) if not text[i].isspace()]
        counts[max(k for k, s in enumerate(starts) if s <= (inside[0] if inside else a))] += 1
    return list(zip(starts, counts))


def test_section_counts(spark):
    library = corpus.tokenizer(BYTE)
    docs = corpus.documents(spark, [t for t in corpus.texts() if len(t or "") < 9000] + odd_texts(200))
    got = defaultdict(list)
    for r in tokencount.section_tokens(docs, corpus.vocabulary(BYTE)).collect():
        got[r.doc_id].append(r)
    for doc in docs.select("doc_id", "text").collect():
        own, text = sorted(got[doc.doc_id], key=lambda r: r.section), doc.text or ""
        assert [(r.start, r.n_tokens) for r in own] == brute_sections(text, library, tokencount.BORDER)
        assert sum(r.n_chars for r in own) == len(text) and {r.doc_tokens for r in own} == {sum(r.n_tokens for r in own)}
    assert tokencount.section_tokens(corpus.empty(spark), corpus.vocabulary(BYTE)).count() == 0
    mixed = corpus.mixed(spark)
    assert tokencount.section_tokens(mixed, corpus.vocabulary(BYTE)).filter("section = 0").count() == mixed.count()
