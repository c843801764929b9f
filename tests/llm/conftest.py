import random

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the documents.
EXTRA = "_id long, _text string, _row int, _h int, _sha string, score double, ids string, node int, label string, rank int, `_place` string, `a.b` int"
EXTRA_VALUES = (7, "x", 1, 2, "s", 0.5, "i", 3, "l", 4, "p", 5)


def words(rng, n, of=3000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty texts, ties, repeated rows, copies near and exact, one long text."""
    rng = random.Random(4)
    base, passage = words(rng, 120), words(rng, 40)
    texts = [
        None, "", " \t\n", base, base, base.replace(" ", "\n", 5), base + " tail", passage + " " + words(rng, 30), words(rng, 25) + " " + passage,
        "one two three", "One  TWO three", words(rng, 9000), passage + " " + passage, "ÄÖ ü   ß 漢字 \U0001f600", "same line\nnext line\n\nsame line\nnext line\n", "same line\nnext line", "123 456", ".", "w " * 300,
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *EXTRA_VALUES) for r in odd_rows], COLUMNS + ", " + EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
