"""Odd documents: nulls, empty and long texts, ties, repeated rows, columns whose names clash with inner ones."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, key int, fp double, word string, n long, range int, jump string"


def clashing(rows: list[tuple]) -> list[tuple]:
    return [(i, t, lang, "s", None, "r", "i", 1, 0.5, "w", 7, 3, "j") for i, t, lang in rows]


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["the", "of", "une", "maison", "haus", "und", "mit", "x1", "Ärger", "don't", "naïve", "你好"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(150)
    rows = [(i, prose(rng.randint(1, 60)), rng.choice(["en", "fr", "de", None])) for i in range(40)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, " \t\n ", None), (103, "12 34 !!", "en"), (104, "你好", None)]
    rows += [(105, f"{prose(9)}\n{passage} {prose(4)}", "en"), (106, f"{passage}", "en"), (107, f"A{passage}B", "fr")]
    rows += [(108, prose(30_000), "fr"), (109, "ab" * 30_000, None), (110, "a b c  d\t\te", "en")]
    rows += [(111, "same  text", "en"), (112, "same text", "en"), (113, "same\ttext", "fr"), (114, "Same text", "en")]
    rows += [(115, "released under the MIT license\nApache License version 2, cc by nc; under the mit license", "en")]
    rows += [(7, "same text", "en"), (7, "same text", "en"), (None, "same text", None), (None, None, None), (-3, "same text", "de")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """As read from a table, in several files."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(clashing(odd_rows()), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(odd):
    return [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
