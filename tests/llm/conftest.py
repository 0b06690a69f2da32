import random

import pytest

from tessera.llm import _tables

#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket string, part string, h string, lane string, slot string, fp string, c0 string, spans string, rank string, data string"


@pytest.fixture(autouse=True)
def few_groups(monkeypatch):
    monkeypatch.setattr(_tables, "LEAST_GROUPS", 3)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and a long one."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 120), 2000) for _ in range(40)]
    passage = words(rng, 30, 2000)
    out = list(base)
    out += [base[3], base[3], base[7]]
    for i in range(25):
        w = base[1 + i % 6].split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        out.append(" ".join(w))
    out += [f"{words(rng, 5)} {passage}\n{words(rng, 9)}" for _ in range(6)]
    out.append(words(rng, 3000, 5000))
    return out


@pytest.fixture(scope="session")
def odd_rows(texts):
    """Rows with nulls, blanks, repeats and ties; then plain ones."""
    rows = [(None, "a b c d e f g h i j k l m n o p"), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (6, "one two"), (7, "One TWO"), (7, "other text of id seven"), (8, "é\u2581ü \u3042 \U0001f600 x" * 3)]
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    return [(d, t, "en", f"src{(d or 0) % 3}" if d != 3 else None, len(t or ""), *["x"] * 10, None) for d, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, CLASH)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASH)
