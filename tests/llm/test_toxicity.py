import random

import pytest
from pyspark.sql import functions as F

from effectspark.llm import toxicity

BAD = ["moronic", "scumbag", "vilefu", "vileza", "vilequo"]


@pytest.fixture(scope="module")
def corpus(prose):
    """Texts with two or more bad words, some of them made of a bad stem, and clean ones."""
    r = random.Random(1)
    rows = []
    for i in range(400):
        words = prose(1000 + i, words=80).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                bad = r.choice(BAD[:2]) if r.random() < 0.6 else "vile" + prose(r.randint(0, 999), words=1)
                words.insert(r.randint(0, 80), bad.capitalize() + r.choice(["", ",", "."]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture()
def model(spark, corpus, documents, tables):
    half = [(i, t) for i, t, _ in corpus if i % 2]
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in corpus if i % 2], "doc_id bigint, quality int, toxic int")
    return toxicity.fit(documents(half), labels, tables)


def test_held_out_documents(spark, corpus, documents, model, tables):
    df = documents([(i, t) for i, t, _ in corpus if i % 2 == 0])
    got = toxicity.score(df, model)
    assert set(got.columns) == {*df.columns, "score", "spans"}
    truth = {i: y for i, _, y in corpus}
    rows = got.collect()
    assert all((r.score >= toxicity.TOXIC_FROM) == bool(truth[r.doc_id]) for r in rows)
    for r in rows:
        found = {r.text[s.start : s.end].lower() for s in r.spans}
        assert all(any(w in f for f in found) for w in ("moronic", "scumbag") if w in r.text.lower())
        assert all(f.startswith(("moronic", "scumbag", "vile")) for f in found)


def test_odd_rows(documents, odd_rows, model, tables):
    rows = toxicity.score(documents(odd_rows), model).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r.score < toxicity.TOXIC_FROM and r.spans == [] for r in rows)


def test_offsets_survive_lower_casing(documents, model, tables):
    text = "İİ Moronic İ Scumbag, Moronic"
    spans = toxicity.score(documents([(1, text)]), model).first().spans
    assert [text[s.start : s.end] for s in spans] == ["Moronic", "Scumbag, Moronic"]


def test_one_long_text(documents, prose, model, tables):
    text = prose(5, words=30_000) + " moronic scumbag " + prose(6, words=30_000)
    row = toxicity.score(documents([(1, text)]), model).first()
    assert [text[s.start : s.end] for s in row.spans] == ["moronic scumbag"]


def test_empty_table(documents, model, tables):
    assert toxicity.score(documents([]), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, None), (2, 1)], [(1, 0), (1, 1), (2, 1)]])
def test_without_both_classes_every_score_is_zero(spark, documents, tables, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    df = documents([(1, "a"), (2, "b")])
    model = toxicity.fit(df, table, tables)
    assert model is None
    assert {r.score for r in toxicity.score(df, model).collect()} == {0.0}


def test_only_the_text_counts(documents, corpus, model, tables):
    df = documents([(i, t) for i, t, _ in corpus[:20]])
    scores = {r.text: r.score for r in toxicity.score(df, model).collect()}
    other = df.withColumns({"doc_id": F.col("doc_id") + 5000, "lang": F.lit("xx"), "source": F.lit("y")})
    assert {r.text: r.score for r in toxicity.score(other, model).collect()} == pytest.approx(scores)


def test_the_sample_is_bounded(spark, documents, corpus, tables):
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id bigint, toxic int")
    assert toxicity.fit(documents([(i, t) for i, t, _ in corpus]), labels, tables, sample_rows=50) is not None
    ids = spark.read.parquet(next(tables.root + "/" + p for p in _folders(tables.root) if "sample-ids" in p))
    assert {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()} == {0: 50, 1: 50}


def _folders(root):
    import os

    return os.listdir(root.removeprefix("file://"))
