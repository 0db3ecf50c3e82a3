import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, words array<string>"


def sentence(r, n, vocab):
    return " ".join(r.choice(vocab) for _ in range(n))


def make_docs(seed=5, n=60):
    """Documents with copies, near copies, shared passages, long and empty texts, nulls and repeats."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeiouthnrs") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["é", "日本", "x!"]
    passage = sentence(r, 70, vocab)
    base = sentence(r, 140, vocab)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind == 2:
            t = sentence(r, 30, vocab) + "\n" + passage + "\t " + sentence(r, 30, vocab)
        elif kind == 3:
            t = sentence(r, r.randint(1, 4), vocab)
        elif kind == 4:
            t = "spam ham " * 90
        else:
            t = sentence(r, r.randint(20, 200), vocab)
        rows.append((i * 3 % 101, t))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, sentence(r, 6000, vocab)), (504, "y" * 3000), (506, "y" * 1500 + sentence(r, 40, vocab)), (505, rows[5][1]), (505, rows[5][1]), (505, rows[6][1] + " tail"), (505, passage + " " + base)]
    return [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 0.5, ["clash"]) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
