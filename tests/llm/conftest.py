import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, norm string, h long, tag int, block long, bytes string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}{rng.choice(['', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, repeated lines, nulls, empty and long ones, and columns whose names operators use."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        texts += [t, t.replace(" ", "\n\t ", 3), t.upper()]
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
    line = "A line of boiler plate, forty characters long at the least"
    texts += [f"{prose(rng, 20)}\n {line.upper() if i % 2 else line} \n{prose(rng, 5)}\n{line}" for i in range(8)]
    texts += [None, "", " \n\t", "one two", "one  two", "é" * 60, "ab" * 4000, "ab" * 300 + "x" + "ab" * 300, prose(rng, 5000)]
    rng.shuffle(texts)
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src7", None]), 0, "n", 1, 2, 3, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, and rows that repeat an id."""
    return spark.createDataFrame([(None, "a b c d e f g h", *[None] * 8), (1, "a b c d e f g h", *[None] * 8), (1, "a b c d e f g h", *[None] * 8), (2, None, *[None] * 8)], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
