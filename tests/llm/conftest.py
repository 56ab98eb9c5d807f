import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, qr_kept string, sh_shard string, lang_pred string"


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", "y", "z")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Plain documents with copies and near copies, and every odd case: nulls, empty, long, ties, repeats."""
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(30):
        text = " ".join(rng.choices(words, k=rng.randint(30, 120)))
        rows.append(_row(k, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
        k += 1
    for base in range(6):
        for _ in range(4):
            tokens = rows[base][1].split(" ")
            for _ in range(rng.randint(0, 2)):
                tokens[rng.randrange(len(tokens))] = rng.choice(words)
            rows.append(_row(k, " ".join(tokens), source=rng.choice(["a", "b"])))
            k += 1
    rows += [
        _row(100, None), _row(101, ""), _row(102, "  \n\t "), _row(103, "one two"), _row(104, "One TWO"), _row(105, "one two three four five"),
        _row(106, "ONE two three\x0bfour  five"), _row(107, " ".join(rng.choices(words, k=30000))), _row(108, rows[0][1].upper()), _row(109, "é ü " * 40, None, None),
        rows[3], rows[3], _row(None, rows[5][1]), _row(None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
