"""Small tables for the operators' tests."""

import random

import public_tokenizers
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, ids string, shard string, root int"


def vocabulary(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def prose(rng, words):
    return " ".join("".join(rng.choice(["ta", "ri", "mon", "é", "la", "s", "X"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def texts():
    """Empty, white, odd, very long, repeated and nearly repeated texts."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (1, 3, 5, 40, 300)]
    odd = [
        "",
        None,
        " \t\n ",
        "a",
        "!!!",
        "  two  spaces\n\n\tand\r\nbreaks ",
        "it's we'll DON'T x2 ½² <|endoftext|> end",
        "日本語のテキスト、と😀 emoji",
        "\x1cq.\x1cz\x85   wide",
        "Under the MIT License and the Apache License, Version 2.0 or CC-BY-NC",
        "x" * 5000,
        "ha" * 3000,
        prose(rng, 30_000),
    ]
    near = [base[4].replace(" ", "  "), base[4] + " tail", " ".join(base[4].split()[:-1])]
    return base + odd + near + base[2:4] + [base[4]] * 3 + ["", None]


def documents(spark, rows=None):
    """One row a text, in an order unlike that of the ids, with columns whose names operators use inside."""
    rows = texts() if rows is None else rows
    out = [((7 * i) % 997, t, "en" if i % 3 else None, "s", None, i, "x", None, 3) for i, t in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def mixed(spark):
    """Also a null id, and whole rows repeated."""
    docs = documents(spark)
    again = docs.filter("doc_id IN (0, 7, 14)")
    keyless = docs.filter("doc_id = 21").selectExpr("CAST(NULL AS long) AS doc_id", *docs.columns[1:])
    return docs.union(again).union(keyless)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
