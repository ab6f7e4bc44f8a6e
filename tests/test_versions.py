"""Committed versions: whole or not at all."""

import pytest

from effectspark.operators import effects as E
from effectspark.sources import model_store
from effectspark.sources.versions import Versions, VersionTaken

ROWS = [(u, i, float((u * i) % 5)) for u in range(6) for i in range(4)]


@pytest.fixture()
def model(spark, ws):
    def make(shift):
        frame = ws.save(spark.createDataFrame([(u, i, x + shift * u) for u, i, x in ROWS], "user_id int, item_id int, rating double"), "frame").df
        return E.fit(frame, (E.ITEM, E.USER), ws, [1.0], held=None)

    return make


def effects_of(model):
    return sorted((r["effect"], r["key"], round(r["b"], 9)) for r in model.long().collect())


def test_a_save_that_dies_half_way_leaves_the_old_model(spark, ws, model, monkeypatch):
    path, old, new = ws.path("model"), model(0), model(1)
    model_store.save_model(old, path)
    broken = new.tables[1].stored.df.selectExpr("user_id", "n", "CAST(raise_error('lost') AS DOUBLE) AS b_0")
    object.__setattr__(new.tables[1].stored, "df", broken)
    with pytest.raises(Exception, match="lost"):
        model_store.save_model(new, path)
    assert Versions(spark, path).numbers() == [0]
    assert effects_of(model_store.load_model(spark, path, ws)) == effects_of(old)


def test_two_writers_do_not_mix(spark, ws, model, monkeypatch):
    path, one, two = ws.path("model"), model(0), model(1)
    versions = Versions(spark, path)
    seen = Versions.latest
    model_store.save_model(one, path)
    answers = iter([None])  # the second writer looked before the first had committed
    monkeypatch.setattr(Versions, "latest", lambda self: next(answers, seen(self)))
    model_store.save_model(two, path)
    monkeypatch.undo()
    assert versions.numbers() == [0, 1]
    assert effects_of(model_store.load_model(spark, path, ws, 0)) == effects_of(one)
    assert effects_of(model_store.load_model(spark, path, ws)) == effects_of(two)


def test_a_version_is_committed_once(spark, ws):
    versions = Versions(spark, ws.path("v"))
    assert versions.latest() is None
    versions.commit(3, {"x": "é"})
    with pytest.raises(VersionTaken):
        versions.commit(3, {"x": "other"})
    assert versions.read(3) == {"x": "é"} and versions.latest() == 3
    assert versions.commit_next({"x": 2}) == 4
    assert versions.numbers() == [3, 4]


def test_old_versions_can_be_forgotten(spark, ws, model):
    path = ws.path("model")
    for shift in range(3):
        model_store.save_model(model(shift), path)
    want = effects_of(model_store.load_model(spark, path, ws))
    lost = Versions(spark, path).new_folder()
    spark.range(1).write.parquet(lost)
    Versions(spark, path).forget(keep=1)
    assert Versions(spark, path).numbers() == [2]
    assert not ws.exists(lost)
    assert effects_of(model_store.load_model(spark, path, ws)) == want


def test_there_is_no_model_yet(spark, ws):
    with pytest.raises(FileNotFoundError):
        model_store.load_model(spark, ws.path("model"), ws)
