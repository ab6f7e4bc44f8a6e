"""What queries of a session share follows the input files."""

import shutil

import pytest

from effectspark.plans import catalog
from effectspark.sources.store import Workspace


def test_an_answer_changes_with_its_tables(spark, tiny, tmp_path):
    folder = tmp_path / "data"
    shutil.copytree(tiny, folder)
    rmse = catalog.queries()["rmse_naive"]
    ask = lambda path: rmse(spark, str(path)).first()["rmse"]
    before = ask(folder)
    assert before == ask(tiny) == ask(folder)
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet").filter("l_orderkey % 2 = 0").coalesce(1)
    shutil.rmtree(folder / "lineitem.parquet", ignore_errors=True) or (folder / "lineitem.parquet").unlink(missing_ok=True)
    lines.write.parquet(str(folder / "lineitem.parquet"))
    other = tmp_path / "other"
    shutil.copytree(folder, other)
    assert ask(folder) == ask(other) != before


def test_the_old_copy_is_deleted_and_an_unchanged_one_kept(spark, ws, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    made = []

    def make():
        made.append(ws.save(spark.read.parquet(source), "copy"))
        return made[-1]

    ask = lambda: ws.kept("copy", (), [source], make)
    assert ask() is ask() and len(made) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert ask().rows == 8
    assert not ws.exists(made[0].path) and ws.exists(made[1].path)


@pytest.mark.parametrize("change", ["length", "name"])
def test_fingerprints(spark, tmp_path, change):
    ws = Workspace(spark)
    (tmp_path / "a.txt").write_text("one")
    first = ws.fingerprint([str(tmp_path)])
    assert first == ws.fingerprint([str(tmp_path)])
    if change == "length":
        (tmp_path / "a.txt").write_text("three")
    else:
        (tmp_path / "a.txt").rename(tmp_path / "b.txt")
    assert ws.fingerprint([str(tmp_path)]) != first
    ws.drop()
