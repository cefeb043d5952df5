"""Neighbours, classifiers and the pipeline: brute force and held-out quality."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook.llm import language, neighbours, toxicity
from casebook.llm.common import table
from casebook.llm.queries import ORACLES, QUERIES
from tests.llm import corpus
from tests.llm.test_duplicates import brute_exact, brute_near
from tests.llm.test_tokens import check_packing

ROOT = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, leaf int, score string"


def vectors(spark, n=900, seed=4):
    """Clusters, a vector that a third of all rows share, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)) + 3 * rng.normal(size=(30, 16))[rng.integers(0, 30, n)]
    x[: n // 3] = x[0]
    rows = [(i, [float(np.float32(v)) for v in row], 1, "s") for i, row in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(2000 + 10 * i, v, 1, "s") for i, v in enumerate(odd)] + [(None, [1.0] * 16, 1, "s")]
    return spark.createDataFrame(rows, VECTORS), np.array([r[1] for r in rows[:n]])


def exact_neighbours(x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    d[i] = np.inf
    return [(int(j), d[j]) for j in np.lexsort((np.arange(len(x)), d))[:k]]


def test_all_leaves_give_exact_neighbours(spark):
    frame, x = vectors(spark)
    rows = neighbours.search(frame, F.col("vec_id") % 10 == 0, k=5, leaf=20, recall=1.01, calibration=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: exact_neighbours(x, i, 5) for i in range(0, 900, 10)}


def test_calibrated_recall(spark):
    frame, x = vectors(spark, n=3000, seed=8)
    rows = neighbours.search(frame, F.col("vec_id") % 10 == 0, k=10, leaf=50, calibration=100).collect()
    found = {(r.query_id, r.vec_id) for r in rows}
    true = {(i, j) for i in range(0, 3000, 10) for j, _ in exact_neighbours(x, i, 10)}
    assert len(found & true) >= 0.9 * len(true)


def test_few_or_no_vectors(spark):
    frame, _ = vectors(spark)
    few = frame.filter("vec_id IN (10, 400)")
    rows = neighbours.search(few, F.col("vec_id") == 10).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(10, 1, 400)]
    assert neighbours.search(frame.filter("vec_id >= 2000 OR vec_id IS NULL"), F.lit(True)).count() == 0
    assert neighbours.search(frame, F.lit(False)).count() == 0


def test_best_bin_first_lists_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    tree = neighbours.Tree.fit(x, 20)
    order = tree.visits(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and set(tree.assign(x)) <= set(order)
    assert neighbours.Tree.fit(np.ones((50, 3)), 5).leaves == 1


def test_machine_learns_a_pair_that_no_weight_shows():
    """Label 1 only if exactly one of two terms is there."""
    rows = [np.array(r, np.int64) for r in ([0], [1], [0, 1], [])] * 50
    toxic = np.array([1, 1, 0, 0] * 50)
    machine = toxicity.Machine.fit(np.array([3, 9]), rows, toxic, rounds=800)
    assert [machine.score(r) >= 0.7 for r in rows[:4]] == [True, True, False, False]


def learned(spark, texts, rows=1500):
    """Scores of unlabelled texts after learning from those that ``texts(i)`` gives with their labels."""
    made = [(i, *texts(i)) for i in range(rows)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")
    scorer = toxicity.Scorer(toxicity.learn(docs, labels))
    return [(y, scorer(t)) for _, t, y in ((i, *texts(i)) for i in range(rows, rows + 400))]


def filler(i, words=40):
    rng = np.random.default_rng(i)
    return " ".join("".join(chr(97 + c) for c in np.random.default_rng(w).integers(0, 26, 7)) for w in (800 * rng.random(words) ** 2).astype(int))


def test_pair_of_neutral_terms_is_learned_from_documents(spark):
    """Two terms, each as frequent in both classes: toxic only with both or with neither."""

    def texts(i):
        first, second = i % 2, i // 2 % 2
        return f"{filler(i)} {'gruppe' * first} {'hassen' * second}", int(first == second)

    scores = learned(spark, texts)
    assert np.mean([(s >= 0.7) == bool(y) for y, s in scores]) >= 0.97


def test_rare_insults_are_learned_from_documents(spark):
    """Each of 80 insults is in about 1.2% of the toxic documents."""

    def texts(i):
        toxic = int(i % 2 == 0)
        return f"{filler(i)} {'zq' + chr(97 + i // 2 % 8) + chr(97 + i // 16 % 10) + 'x' if toxic else ''}", toxic

    scores = learned(spark, texts, rows=3000)
    assert np.mean([s >= 0.7 for y, s in scores if y]) >= 0.9 and np.mean([s >= 0.7 for y, s in scores if not y]) <= 0.05


def test_toxicity_on_held_out_documents(spark):
    rows = QUERIES["op7_toxicity"](spark, ROOT).join(table(spark, ROOT, "labels"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.7 and np.mean([r.predicted for r in clean]) <= 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_tables(spark):
    docs = corpus.mixed(spark)
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (7, None, None), (None, 1, 1), (14, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert not [r for r in rows if r.doc_id is None and r.held_out]
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(corpus.empty(spark), labels).count() == 0


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op10_language"](spark, ROOT).join(table(spark, ROOT, "documents"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98


def test_language_of_odd_texts(spark):
    lines = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("123 !!", "en"), ("the and", None)] * 4
    docs = spark.createDataFrame([(3 * i, t, x, 0) for i, (t, x) in enumerate(lines)], "doc_id long, text string, lang string, score int")
    for r in language.languages(docs).collect():
        text, lang = lines[r.doc_id // 3]
        assert r.lang_pred == ("und" if text is None or text.startswith("1") else lang or "en") and 0 <= r.score <= 1
    assert language.languages(corpus.empty(spark)).count() == 0
    unlearned = language.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_out_of_place_distance_by_hand():
    profile = pd.DataFrame({"lang": ["x"] * 3 + ["y"] * 3, "gram": ["a", "b", "c", "c", "b", "d"], "rank": [0, 1, 2] * 2})
    own = language.Identifier(profile, size=3)
    # a (3 times), aa, b (twice, in text order): x differs by 0, 3 (no aa) and 1, y by 3, 3 and 1
    assert own("aaa bb c") == ("x", 3 / 7, 4 / 9)
    assert own("zz")[2] == 1.0 and own("1_2") == ("und", 0.0, 1.0)


def plain_language(ranks, text, size):
    """The out-of-place rule over every n-gram of a text, in plain Python."""
    n = {}
    for word in language.LETTERS.findall((text or "").lower()):
        for gram in language.grams(word):
            n[gram] = n.get(gram, 0) + 1
    if not n:
        return "und", None
    top = sorted(n, key=lambda g: (-n[g], g))[:size]
    apart = {x: sum(abs(own[g] - i) if g in own else size for i, g in enumerate(top)) for x, own in ranks.items()}
    found = min(sorted(apart), key=apart.get)
    return found, apart[found] / (size * len(top))


def test_language_equals_the_plain_rule(spark):
    docs = corpus.mixed(spark).select("doc_id", "text").withColumn("lang", F.element_at(F.array(*map(F.lit, "xyz")), F.length(F.coalesce("text", F.lit(""))) % 3 + 1))
    docs = docs.unionByName(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang"))
    learned = language.profiles(docs)
    ranks = {x: dict(zip(own.gram, own["rank"])) for x, own in learned.groupby("lang")}
    assert len(ranks) >= 6
    forgetful = language.Identifier(learned, most=50, most_grams=20)
    noisy = ["der cat est la", "xx yy 漢字 漢字", "𐐷𐐷 a\u0301", "qzx " * 9]
    texts = [r.text for r in docs.select("text").collect()] + noisy
    whole = language.Identifier(learned)
    for text in texts:
        lang, _, distance = whole(text or "")
        plain = plain_language(ranks, text, language.PROFILE)
        assert lang == plain[0] and plain[1] in (None, distance)
        assert forgetful(text or "") == whole(text or "")
    rows = language.languages(docs).collect()
    assert sorted(r.lang_pred for r in rows) == sorted(plain_language(ranks, t, language.PROFILE)[0] for t in texts[: -len(noisy)])


def test_language_stage_keeps_what_no_profile_can_judge(spark):
    lines = [("the cat and the dog", "en"), ("漢字", None), (None, "en"), ("12 !", None)]
    docs = spark.createDataFrame([(3 * i, t, x, 0) for i, (t, x) in enumerate(lines)], "doc_id long, text string, lang string, distance int")
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert [r.doc_id for r in stage(spark, docs, ROOT).collect()] == [0]
    unlearned = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in stage(spark, unlearned, ROOT).collect()} == {0, 3}


def test_pipeline_stages_by_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        assert after.columns == columns
        path_rows = after.collect()
        rows = before.collect()
        kept = {r.doc_id for r in path_rows}
        assert len(kept) == len(path_rows) and kept <= {r.doc_id for r in rows}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.001", "labels").collect()}
            clean = [r.doc_id for r in rows if labels.get(r.doc_id) == 0]
            assert np.mean([i in kept for i in clean]) >= 0.97
        if name == "language":
            learned = language.profiles(before)
            ranks = {x: dict(zip(own.gram, own["rank"])) for x, own in learned.groupby("lang")}
            plain = {r.doc_id: plain_language(ranks, r.text, language.PROFILE) for r in rows}
            assert kept == {i for i, (x, far) in plain.items() if x != "und" and far < 1}
        if name == "exact_dedup":
            assert kept == {k[0] for k in brute_exact(rows) if k[3]}
        if name == "near_dedup":
            assert kept == {k[2] for k in brute_near(rows)}
        before = spark.createDataFrame(path_rows, docs.schema)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_packing(rows, {r.doc_id: r.text for r in path_rows}, 1024)


def test_pipeline_of_nothing(spark):
    docs = corpus.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    df = QUERIES[name](spark, ROOT)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
