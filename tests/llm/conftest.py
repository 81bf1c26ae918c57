import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, runs string, kept string, host string, text_key string"


@pytest.fixture(scope="session")
def texts():
    """Distinct (doc_id, text): copies, near copies, shared passages, odd texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), prose(200).split()
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, "x" * 5000), (7, "ab " * 3000), (8, "ab " * 3000), (9, "a" * 250), (10, "\n\n".join(["same line here"] * 40))]
    for i in range(11, 31):
        rows.append((i, prose(rng.randint(1, 30)) + "\n" + passage + " " + prose(rng.randint(1, 300))))
    for i in range(31, 61):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, rows[i - 51][1]) for i in range(61, 71)]
    rows += [(71, "漢字　かな 😀  nbsp don't <|endoftext|> I'LL ½"), (72, prose(20000))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table, with clashing extra columns that hold nulls."""
    rows = [(d, t, None if d % 7 == 0 else "en", None if d % 5 == 0 else f"src{d % 3}", len(t or ""), None, "r", "k", None, "t") for d, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without an id, equal rows, and one id with two texts."""
    long = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(None, long), (None, None), (1, long), (1, long), (2, long), (2, "short text"), (3, None)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
