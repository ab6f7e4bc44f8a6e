import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from effectspark.llm import near_dedup
from effectspark.llm.components import components
from effectspark.llm.shingles import Shingler, linked


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    """Every pair of texts compared."""
    nodes = list(dict.fromkeys(rows))
    sets = {n: shingle_set(n[1]) for n in nodes}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for n in nodes:
        if n[0] is not None and (least[find(n)] is None or n[0] < least[find(n)]):
            least[find(n)] = n[0]
    return Counter((i, len(sets[(i, t)]), least[find((i, t))], i == least[find((i, t))]) for i, t in rows)


def found(df, tables):
    got = near_dedup.near_duplicates(df, tables)
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())


def edited(text, changes, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"w{r.random()}"
    return " ".join(words)


def test_odd_rows(documents, odd_rows, tables):
    rows = odd_rows + [(11, "ONE TWO"), (12, "one\ttwo\n"), (13, "É x"), (14, "é x"), (15, None), (16, "")]
    assert found(documents(rows), tables) == plain(rows)


def test_empty_table(documents, tables):
    assert not found(documents([]), tables)


def test_copies_near_copies_and_chains(documents, prose, tables):
    rows = []
    for g in range(25):
        text = prose(g, words=120)
        for k in range(g % 6 + 1):
            rows.append((len(rows) * 7 % 1009, text))
            text = edited(text, k, g * 100 + k)  # each from the one before: chains
    assert len({i for i, _ in rows}) == len(rows)
    assert found(documents(rows), tables) == plain(rows)


def test_nodes_too_large_to_compare_branch_on(documents, prose, tables, monkeypatch):
    """A passage in all documents, large groups of near copies, and nodes far over the limit."""
    monkeypatch.setattr(near_dedup, "SMALL", 12)
    common = prose(0, words=60)
    rows = [(i, f"{common} {prose(500 + i, words=50)}") for i in range(60)]
    rows += [(100 + i, edited(prose(1, words=150), i % 4, i)) for i in range(60)]
    rows += [(200 + i, edited(f"{common} {prose(2, words=150)}", i % 3, i)) for i in range(30)]
    assert found(documents(rows), tables) == plain(rows)


@pytest.mark.parametrize("share", [0.81, 0.85])
def test_no_link_is_lost_in_a_large_template_group(documents, prose, tables, monkeypatch, share):
    """Members are too different to be linked among themselves (0.68 to 0.74), and far too many for one comparison."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    template, r = prose(0, words=400).split(), random.Random(8)
    rows = []
    for k in range(220):
        own = prose(1000 + k, words=400).split()
        cut = int(404 * share)
        rows.append((k, " ".join(template[:cut] + own[cut:])))
    for k in range(60):  # planted links, just above the threshold
        words = rows[r.randrange(220)][1].split()
        at = r.randrange(10, 200)
        words[at : at + 44] = [f"q{k}x{j}" for j in range(44)]
        rows.append((500 + k, " ".join(words)))
    want = plain(rows)
    assert 20 < sum(not kept for _, _, _, kept in want) < 200
    assert found(documents(rows), tables) == want


def test_tiles_bring_every_pair_together(spark):
    rows = [(1, f"n{k}".encode(), b"m" if k < 70 else f"r{k % 90}".encode(), b"m", 160, 90) for k in range(160)]
    df = spark.createDataFrame(rows, "path bigint, node binary, root binary, main binary, members bigint, outside bigint")
    near_dedup.SMALL, kept = 20, near_dedup.SMALL
    try:
        parts = near_dedup._tiles(df).collect()
    finally:
        near_dedup.SMALL = kept
    members = defaultdict(set)
    for r in parts:
        members[r.part].add(bytes(r.node))
    assert max(map(len, members.values())) <= 60  # about 20, in tiles dealt by hash
    met = {(a, b) for group in members.values() for a in group for b in group}
    outside = {f"n{k}".encode() for k in range(70, 160)}
    assert all((a, f"n{k}".encode()) in met for a in outside for k in range(160))


def test_the_limit_itself_is_linked(documents, tables):
    words = [f"w{i}" for i in range(200)]
    base = " ".join(words[:104])  # 100 shingles
    rows = [(1, base), (2, " ".join(words[:79])), (3, " ".join(words[:78])), (4, " ".join(words[100:200]))]
    got = {r[0]: r[2] for r in found(documents(rows), tables)}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}  # 75 of 100 is enough; 74 of 75 links 3 to 2
    rows = [(1, base), (3, " ".join(words[:78]))]
    assert {r[0]: r[2] for r in found(documents(rows), tables)} == {1: 1, 3: 3}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("a b A c É \t\n\x0b\x1c  ".split(" ") + [" ", "\n", "ab"]), max_size=30).map("".join))
def test_shingles(text):
    want = shingle_set(text)
    got = Shingler().hashes(text)
    assert len(got) == len(want)
    assert linked(got, got, 75) == bool(want)


def test_long_texts_are_split_in_pieces(monkeypatch, prose):
    text = prose(1, words=400) + "  \n " + "y" * 200
    whole = Shingler().hashes(text)
    monkeypatch.setattr("effectspark.llm.words.PIECE", 30)
    assert (Shingler().hashes(text) == whole).all()


def test_minwise_values_do_not_depend_on_blocks(monkeypatch):
    shingles = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    whole = near_dedup.minwise(shingles)
    monkeypatch.setattr(near_dedup, "_BLOCK", 17)
    assert (near_dedup.minwise(shingles) == whole).all()


@pytest.mark.parametrize("bits", [1 << 29, 0])
def test_sets_are_joined_by_few_pairs(monkeypatch, bits):
    monkeypatch.setattr(near_dedup, "BITS_HELD", bits)
    r = np.random.default_rng(2)
    for _ in range(40):
        base = r.integers(0, 1 << 62, (3, 60), dtype=np.uint64)
        sets = [np.unique(np.where(r.random(60) < r.random() * 0.4, r.integers(0, 1 << 62, 60, dtype=np.uint64), base[r.integers(3)]))
                for _ in range(25)]
        label = r.integers(0, 20, len(sets))
        want = label.copy()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if linked(a, b, 75) and want[i] != want[j]:
                    want[want == want[j]] = want[i]
        got = label.copy()
        pairs = near_dedup.join_sets(sets, label, 75)
        for i, j in pairs:
            assert linked(sets[i], sets[j], 75) and got[i] != got[j]
            got[got == got[j]] = got[i]
        assert len(pairs) < len(sets)
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(25) for j in range(25))


def test_agreement_estimates_similarity():
    r = np.random.default_rng(1)
    shared = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = (np.concatenate([shared, r.integers(0, 1 << 63, 500, dtype=np.uint64)]) for _ in range(2))
    sketches = [(near_dedup.minwise(x)[near_dedup.TREES :] * near_dedup._MIX) >> np.uint64(56) for x in (a, b)]
    assert 0.6 < (sketches[0] == sketches[1]).mean() < 0.9  # 0.75


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    from effectspark.llm.tables import start

    ws = start(spark)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), ws).df.collect()
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(map(tuple, got)) == sorted((n, find(n)) for n in root)
    ws.drop()


def test_links_join_the_components_found_before(spark, tables):
    """Batch after batch of links gives the components of all of them."""
    r = random.Random(4)
    edges = [(f"n{r.randrange(60):02}".encode(), f"n{r.randrange(60):02}".encode()) for _ in range(45)]
    nothing = spark.createDataFrame([], "node binary, root binary")
    links = near_dedup._Links(nothing)
    for at in range(0, 45, 9):
        links.add(tables.save(spark.createDataFrame(edges[at : at + 9], "a binary, b binary"), "links"), tables)
    got = sorted(map(tuple, links.roots.collect()))
    want = sorted(map(tuple, components(spark.createDataFrame(edges, "a binary, b binary"), tables).df.collect()))
    groups = lambda rows: sorted(sorted(n for n, q in rows if q == x) for x in {x for _, x in rows})
    assert groups(got) == groups(want)


def test_a_long_path_is_one_component(spark, tables):
    edges = spark.range(300).selectExpr("(id * 7919) % 307 AS a", "((id + 1) * 7919) % 307 AS b")
    got = components(edges, tables).df
    assert got.count() == 301 and got.select("root").distinct().count() == 1
