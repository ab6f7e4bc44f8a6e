import random

import pytest

from effectspark.llm import decontaminate as D


@pytest.fixture()
def benchmark(spark):
    def make(rows, kind="bigint"):
        return spark.createDataFrame(rows, f"item_id {kind}, text string")

    return make


def found(docs, items, tables):
    return {r.doc_id: (r.contaminated, r.n_items, r.longest, r["items"]) for r in D.contamination(docs, items, tables).collect()}


def with_changes(text, every, seed=0):
    words = text.split()
    for i in range(seed % every, len(words), every):
        words[i] = "changed"
    return " ".join(words)


def test_passages_with_and_without_substitutions(documents, benchmark, prose, tables):
    items = [(k, prose(9000 + k, words=20 + k)) for k in range(30)]
    rows, want = [], {}
    for k, (_, text) in enumerate(items):
        around = prose(k, words=50)
        rows += [(10 * k, around), (10 * k + 1, f"{around} {text.upper()}, {around}"),
                 (10 * k + 2, f"{around} {with_changes(text, 7, k)} {around}"), (10 * k + 3, text)]
        want |= {10 * k: set(), 10 * k + 1: {k}, 10 * k + 2: {k}, 10 * k + 3: {k}}
    got = found(documents(rows), benchmark(items), tables)
    assert {i: set(g[3]) for i, g in got.items()} == want
    assert all(got[10 * k + 1][2] == 20 + k for k in range(30))


def test_two_items_in_one_text_and_parts_of_one(documents, benchmark, prose, tables):
    a, b = prose(1, words=40), prose(2, words=40)
    part = " ".join(a.split()[5:18])
    short = " ".join(a.split()[5:17])
    rows = [(1, f"{a} x {b}"), (2, part), (3, short), (4, f"{b} y {b}")]
    got = found(documents(rows), benchmark([(1, a), (2, b), (3, b)]), tables)
    assert got == {1: (True, 3, 40, [1, 2, 3]), 2: (True, 1, 13, [1]), 3: (False, 0, 0, []), 4: (True, 2, 40, [2, 3])}


def test_too_many_changes_are_no_overlap(documents, benchmark, prose, tables):
    text = prose(1, words=40)
    got = found(documents([(1, with_changes(text, 3)), (2, with_changes(text, 2))]), benchmark([(1, text)]), tables)
    assert not any(g[0] for g in got.values())


def test_odd_documents_and_items(documents, benchmark, odd_rows, prose, tables):
    items = [(None, prose(7)), (1, None), (2, ""), (3, "one two"), (4, "one two three four five"), (5, prose(7)), (5, prose(7))]
    rows = odd_rows + [(20, "x one, two three; four FIVE y"), (21, "one two three four")]
    got = D.contamination(documents(rows), benchmark(items), tables).collect()
    assert len(got) == len(rows)
    for r in got:
        has = r.text is not None and prose(7) in r.text
        assert r.contaminated == (has or r.doc_id == 20)
        assert r["items"] == ([5] if has else [4] if r.doc_id == 20 else [])


def test_empty_tables(documents, benchmark, tables):
    assert found(documents([]), benchmark([(1, "a b c d e f")]), tables) == {}
    assert found(documents([(1, "a b c d e f")]), benchmark([]), tables) == {1: (False, 0, 0, [])}


def test_ids_of_another_type(documents, benchmark, tables):
    got = found(documents([(1, "a b c d e f")]), benchmark([("q", "a b c d e f")], "string"), tables)
    assert got == {1: (True, 1, 6, ["q"])}


def test_blocks_of_items_change_nothing(documents, benchmark, prose, tables):
    items = [(k, prose(50 + k, words=30)) for k in range(20)]
    docs = documents([(k, f"{prose(k)} {t} {prose(300 + k)}") for k, t in items])
    rows = lambda size: sorted(map(tuple, D.find_overlaps(docs, benchmark(items), tables, size).select("item_id", "words", "start").collect()))
    assert rows(1 << 20) == rows(500)
    assert len(rows(500)) == 20


def test_an_item_repeated_very_often_is_searched_for_once(documents, benchmark, prose, tables, monkeypatch):
    sent = []
    search = D._search
    monkeypatch.setattr(D, "_search", lambda shared, *a: sent.append(shared.value) or search(shared, *a))
    text = prose(1, words=30)
    got = found(documents([(1, f"x {text} y")]), benchmark([(1, text)] * 500 + [(2, text)] * 3), tables)
    assert got == {1: (True, 2, 30, [1, 2])}
    assert sum(map(len, sent)) == 2


def test_the_shortest_item_is_a_parameter(documents, benchmark, tables):
    docs, items = documents([(1, "a b c d e f")]), benchmark([(1, "b c d")])
    assert D.find_overlaps(docs, items, tables).count() == 0
    assert [r.words for r in D.find_overlaps(docs, items, tables, shortest=3).collect()] == [3]


def test_long_document(documents, benchmark, prose, tables):
    text = prose(1, words=20)
    doc = prose(2, words=50_000) + " " + text + " " + prose(3, words=50_000)
    assert found(documents([(1, doc)]), benchmark([(1, text)]), tables) == {1: (True, 1, 20, [1])}
