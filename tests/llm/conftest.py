import random

import pytest

from tests.llm.plain import SCHEMA


def made(n=60, seed=1):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = " ".join(r.choice(words) for _ in range(r.randint(5, 90)))
        elif kind == 1:
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(80)] = "edit%d" % r.randrange(9)
            text = " ".join(w)
        elif kind == 2:
            text = "\n".join(" ".join(base[k : k + 16]) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(12)) for k in (0, 16, 32, 48))
        elif kind == 3:
            text = "ABC " * r.randint(1, 60)
        elif kind == 4:
            text = "Émile à l'école, où? 日本語 \U0001f600 token = 'abcdefghijkl%d' deadbeefdeadbeef%d AKIAABCDEFGHIJKLMN" % (i, i)
        else:
            text = rows[r.randrange(len(rows))][1]
        rows.append((i * 3 + 1, text, r.choice(["en", "fr"]), "src0", len(text or "")))
    return rows


EDGES = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \t\n", "en", "s", 3), (-4, "a", None, "s", 1), (-5, "One two", "en", "s", 7), (-6, "one  TWO\n", "en", "s", 9), (1000, "x" * 5000 + " " + "long text " * 3000, "en", "s", 35001)]


@pytest.fixture(scope="session")
def rows():
    return made() + EDGES


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Few rows, two of them the same, with columns named like those that operators add."""
    names = ["row", "doc", "block", "bucket", "kind", "size", "data", "cls", "line", "pos", "key", "rank", "length", "start", "spans", "items", "score", "_row", "_id", "_text", "id", "tok", "gone", "kept"]
    rows = [(1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "s", 27), (2, None, None, None, None), (None, "seven eight nine ten eleven", "fr", "s", 27)]
    return spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], SCHEMA + "".join(f", `{n}` int" for n in names))
