import random

import pytest
from pyspark.sql import functions as F

from effectspark.llm.tables import start

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def tables(spark):
    """A workspace with the operators' settings; gone after the test."""
    ws = start(spark)
    yield ws
    ws.drop()


@pytest.fixture(scope="session")
def prose():
    """Random sentences, the same for a seed."""

    def make(seed, words=60, lines=1):
        r = random.Random(seed)
        letters = "abcdefghijklmnopqrstuvwxyz"
        word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
        return "\n".join(" ".join(word() for _ in range(words)) for _ in range(lines))

    return make


@pytest.fixture()
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows, clash=True):
        df = spark.createDataFrame(
            [(i, t, None, None, len(t) if t is not None else None) for i, t in rows], DOCS
        ).repartition(3)
        if clash:
            names = "key node root path digest second length run rows best body chunk n a b ids words at h block"
            df = df.withColumns({c: F.lit(None).cast("string") for c in names.split()})
            df = df.withColumn("n_lines", F.lit(-1)).withColumn("score", F.lit(7.0)).withColumn("items", F.lit("x"))
        return df

    return make


@pytest.fixture()
def odd_rows(prose):
    """NULLs, empty and blank texts, one very long text, repeated rows, equal texts."""
    long = prose(99, words=40, lines=3000)
    return [
        (None, None), (None, ""), (1, None), (2, ""), (3, " \n\t "), (4, "\x00 é 漢字 🎉\r\n"), (5, long), (6, long),
        (7, prose(7)), (7, prose(7)), (8, prose(7)), (None, prose(7)), (9, "one"), (10, "one two"),
    ]
