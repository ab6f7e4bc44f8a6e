import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from effectspark.llm import oracle, queries
from effectspark.llm.near_dedup import PERCENT


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", oracle.queries())
def test_query_equals_sql(spark, duck, small, name):
    expected = duck.execute(oracle.queries()[name])
    names = [c[0] for c in expected.description]
    got = queries.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, expected.fetchall()))


def test_everything_is_registered():
    names = entry_points.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names


@pytest.fixture()
def folder(spark, tmp_path, documents, prose):
    """Documents of every kind that a stage drops, and the rest."""
    toxic = [(i, f"{prose(i, words=40)} filthbag {prose(i + 1, words=5)} slimeball") for i in range(40)]
    clean = [(100 + i, prose(100 + i, words=50)) for i in range(60)]
    passage = prose(900, words=8, lines=30)
    leak = prose(901, words=25)
    special = [
        (300, passage), (301, f"start {prose(301)}\n{passage}\nend {prose(302)}"), (302, prose(303, words=90)),
        (303, prose(303, words=90) + " more"), (304, f"{prose(305)} {leak} {prose(306)}"), (305, None), (306, ""),
        (None, prose(307)), (307, prose(307, words=3)),
    ]
    docs = documents(toxic + clean + special, clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_drops_what_it_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_ids = {r.doc_id for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    toxic = set(range(40))
    assert kept["toxicity"] == all_ids - toxic
    assert kept["line_dedup"] == kept["toxicity"]
    assert kept["near_dedup"] == kept["line_dedup"] - {303}
    assert kept["decontamination"] == kept["near_dedup"] - {304}
    assert kept["byte_bpe"] == kept["decontamination"]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{folder}/line_dedup").collect()}
    assert "start" in texts[301].text and len(texts[301].text) < 1500 and texts[301].n_chars == len(texts[301].text)
    assert texts[305].text is None and texts[306].text == ""
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert all(r.ids_sha256 and r.decoded_sha256 for r in rows)


def test_empty_documents(spark, tmp_path, documents):
    documents([], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_limits_of_the_stages():
    assert PERCENT == 75
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe",
    ]
