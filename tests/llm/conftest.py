import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def make_docs(seed=1, n=120):
    """Documents with copies, near copies, shared lines, junk, nulls, empty and long texts, ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(words, k=k)).capitalize() + "."
    common = [line(8) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [line(rng.randint(6, 20)) for _ in range(rng.randint(4, 9))]
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), rng.choice(common))
        if i % 12 == 5:
            lines = [" ".join(w + "&&&" for w in x.split()) for x in lines]
        rows.append([i, "\n".join(lines), rng.choice(["en", "fr"]), f"src{i % 5}"])
    for k in range(0, 40, 8):
        rows.append([1000 + k, rows[k][1], "en", f"src{(k + 1) % 5}"])
        rows.append([1001 + k, rows[k][1].upper(), "en", None])
        rows.append([1002 + k, rows[k][1] + " end", "en", "src3"])
    rows += [[2000, None, "en", "src0"], [2001, "", None, "src1"], [2002, " \t\n ", "fr", None], [2003, " ".join(rng.choices(words, k=30_000)), "en", "src2"], [None, "no number here", "en", "src2"], [3, rows[3][1], rows[3][2], rows[3][3]]]
    return [(a, t, g, s, None if t is None else len(t), "x") for a, t, g, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
