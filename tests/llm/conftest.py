"""Small tables with nulls, empty and long texts, repeated rows and columns whose names clash with inner ones."""
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, _h string, copies int, key string"


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["the", "of", "and", "to"] + [f"w{rng.randrange(vocabulary)}x" for _ in range(4)]) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 120)) for _ in range(40)]
    texts = list(base)
    for k in range(10):  # near copies: one word changed
        w = base[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [base[20]] * 5 + [None, None, "", "  \n ", "one", "one", "one two three four", "a b c d e", "z\n" * 300]
    texts.append(prose(rng, 12_000))
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], [None, "a", "b", "c"][min(3, i % 7)], None if t is None else len(t),
             7, "x", None, 1, "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[5], "en", "a", 1, 7, "x", None, 1, "k"), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from websift.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
