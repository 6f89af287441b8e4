import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, size long, h long, rank int, b string, score double"


def prose(r, n, words=400):
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))


def corpus():
    """Documents with nulls, empties, ties, copies, repeated rows, one very long text and columns of clashing names."""
    r = random.Random(3)
    rows, k = [], 0

    def add(text, source="s1", doc_id=...):
        nonlocal k
        k += 1
        i = k if doc_id is ... else doc_id
        rows.append((i, text, "en", source, None if text is None else len(text), 1, 2, 3, 4, "x", 0.5))

    base = prose(r, 200)
    for _ in range(12):
        add(prose(r, r.randint(30, 200)), r.choice(["s1", "s2", "s3"]))
    for i in range(6):  # near copies
        add(base + (f" extra{i}" if i else ""), "s2")
    for _ in range(4):  # exact copies
        add(rows[0][1], "s1")
    add(base.upper(), None)
    add(None)
    add("")
    add(" \n\t ")
    add("one two")
    add("One TWO", "s3")
    add(prose(r, 30000, 9000), "s1")
    add("x" * 200_000, "s1")
    add("tie", "s2")
    add("tie", "s2", rows[-1][0])  # a repeated row
    add(prose(r, 50), "s1", None)
    add("naïve Größe 漢字 " * 30, "s3")
    add("# * $ %\nsame line here\nsame line here\n\n\n" + prose(r, 40), "s3")
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()
