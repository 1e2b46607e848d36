import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, block long, part long"


def corpus(seed=11, n=60):
    """Texts with exact and near copies, shared passages, nulls, empty and blank ones, repeated rows, a long one."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = make(60)
    texts = [make(rnd.randint(1, 160)) for _ in range(n)]
    texts[3] = texts[2]
    texts[4] = texts[2].upper()
    for i in (6, 7, 8, 9):
        own = texts[5] = make(150) if i == 6 else texts[5]
        own = own.split(" ")
        own[rnd.randrange(len(own))] = f"new{i}"
        texts[i] = " ".join(own)
    for i in (12, 13, 14):
        texts[i] = f"{make(20)} {passage} {make(30)}"
    texts[15], texts[16], texts[17] = None, "", " \t\n "
    texts[18] = " ".join(make(5) for _ in range(900))
    texts[19] = "one two"
    texts[20] = "ONE two"
    texts[21] = "a" * 700
    texts[22] = "Straße über Öl, naïve café — 東京 \x85 end"
    texts[23] = texts[18][:6000]
    rows = [(i, t, ("en", "fr", "de", None)[i % 4], ("s1", "s1", "s2", None, "s3")[i % 5], len(t or ""), 1, None, 0.5, 7, 9) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, texts[2], None, None, 0, 1, None, 0.5, 7, 9), (None, "lonely " + make(40), None, "s2", 0, 1, None, 0.5, 7, 9)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[0] % 3, r[0] % 2) for r in rows if r[0] is not None] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
