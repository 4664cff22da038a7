"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket string, rep string, row int, n int"


def make_rows():
    r = random.Random(5)
    words = [("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))) for _ in range(400)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [some(r.randint(20, 300)) for _ in range(40)]
    passage = some(120)
    near = texts[0].split()
    texts += [" ".join(near[:k] + ["zz"] + near[k + 1 :]) for k in range(3, len(near), max(1, len(near) // 12))]
    texts += [texts[1], texts[1].replace(" ", "  \n", 3), some(30) + " " + passage, passage + " " + some(9), "x " + passage + " y"]
    texts += ["aaaa " * 300, "a" * 1500, some(9000), "One two", "one TWO", "", None, "   \n\t", "é ñ ü " * 30, "Hello!! $$$ ### " * 40, "\n".join(["same line here"] * 20), "it's 42 <|endoftext|> don't"]
    rows = [(i * 3 % 997, t, "en", f"s{i % 4}" if i % 9 else None, None if t is None else len(t), i, "b", "c", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[3], None, None, None, 0, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
