import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from effectspark.llm import exact_dedup


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = Counter()
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        own, best = (-len(t or ""), i is None, i), min(groups[bare], key=lambda g: (g[0], g[1], g[2] or 0))
        out[(i, best[2], len(groups[bare]), own == best, hashlib.sha256(bare.encode()).hexdigest())] += 1
    return out


def found(df, tables):
    return Counter(map(tuple, exact_dedup.exact_duplicates(df, tables).collect()))


def test_odd_rows(documents, odd_rows, tables):
    assert found(documents(odd_rows), tables) == plain(odd_rows)


def test_empty_table(documents, tables):
    assert not found(documents([]), tables)


@pytest.mark.parametrize("partitions", [1, 2, 5, 33])
def test_any_number_of_runs(documents, tables, prose, partitions):
    rows = [(i, prose(i % 17) + " " * (i % 3)) for i in range(200)]
    assert found(documents(rows).repartition(partitions), tables) == plain(rows)


def test_a_group_reaches_a_task_as_few_rows(spark, documents, tables):
    rows = [(i, "same text") for i in range(500)]
    got = exact_dedup.exact_duplicates(documents(rows), tables)
    assert got.filter("kept").select("doc_id", "group_size").collect() == [(0, 500)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan and "Python" not in plan


def test_text_that_differs_only_by_white_space_keeps_the_longest(documents, tables):
    rows = [(5, "a b"), (6, "a  b"), (7, "ab"), (4, "a\tb ")]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(documents(rows), tables).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {4: 4, 5: 4, 6: 4, 7: 4}
    assert [i for i, r in got.items() if r.kept] == [4]


def test_other_columns_do_not_matter(documents, tables):
    rows = [(1, "x"), (2, "x")]
    df = documents(rows).withColumn("lang", F.lit("zz"))
    assert found(df, tables) == plain(rows)
