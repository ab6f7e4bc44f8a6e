import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from effectspark.llm import repeats, suffix


def plain(rows, length=repeats.LENGTH):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s, key = raw[p : p + length], (i is None, i or 0)
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (i is None, i or 0):
                gone[p : p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def found(df, tables):
    rows = repeats.remove_repeats(df, tables).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=str
    )


@pytest.fixture()
def mixed(prose):
    r = random.Random(4)
    passages = [prose(700 + k, words=20) for k in range(6)]
    rows = []
    for i in range(80):
        parts = [prose(i, words=r.randint(1, 30))] + r.sample(passages, r.randint(0, 3))
        r.shuffle(parts)
        rows.append((i * 37 % 101, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "ab" * 300), (203, "ab" * 200), (204, "é" * 100), (205, "xé" + "é" * 90)]
    return rows


def test_odd_rows(documents, tables, prose):
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (None, "x" * 50),
            (6, prose(7)), (6, prose(7)), (7, prose(7)), (None, prose(7)), (8, "\x00" * 60), (9, "\x00" * 55 + "a")]
    assert found(documents(rows), tables) == plain(rows)


def test_empty_table(documents, tables):
    assert found(documents([]), tables) == []


@pytest.mark.parametrize(
    "settings_", [{}, {"BLOCK_BYTES": 700, "BUCKET_BYTES": 500}, {"BLOCK_BYTES": 700, "SHARD_BYTES": 300}, {"FREQUENT": 2},
                  {"BLOCK_BYTES": 300, "BUCKET_BYTES": 900, "SHARD_BYTES": 100, "FREQUENT": 3}]
)
def test_blocks_buckets_shards_and_frequent_anchors_change_nothing(documents, mixed, tables, monkeypatch, settings_):
    # tasks are pickled with this module's values only if it travels by value: solve in this process instead
    for k, v in settings_.items():
        monkeypatch.setattr(repeats, k, v)
    assert local(mixed) == plain(mixed)


def local(rows):
    """The tasks of the four steps, called in turn."""
    import pyarrow as pa

    def run(task, rows):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + 3]) for i in range(0, len(rows), 3)]
        return [r for b in task(iter(batches)) for r in b.to_pylist()]

    def grouped(task, rows):
        groups = {}
        for r in rows:
            groups.setdefault(r["bucket"], []).append(r)
        return [x for g in groups.values() for x in task(pa.Table.from_pylist(g)).to_pylist()]

    class Captured:
        def select(self, *_):
            return self

        def mapInArrow(self, task, _):
            return task

    blocks = run(repeats._blocks(Captured()), [{"doc_id": i, "text": t} for i, t in rows])
    buckets = max(1, -(-sum(b["bytes"] for b in blocks) // repeats.BUCKET_BYTES))
    by_block = lambda rows, key: {b["block"]: [r for r in rows if r["block"] == b["block"]] for b in blocks}
    verdicts = by_block(grouped(repeats._judge_anchors, run(repeats._send_anchors(buckets), blocks)), "verdict")
    blocks = [b | {"verdicts": verdicts[b["block"]]} for b in blocks]
    answers = by_block(grouped(repeats._answer, run(repeats._send_pieces(buckets), blocks)), "answer")
    blocks = [b | {"answers": answers[b["block"]]} for b in blocks]
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"])
         for r in run(repeats._cut(buckets), blocks)), key=str,
    )


def test_on_spark(documents, mixed, tables):
    assert found(documents(mixed), tables) == plain(mixed)


def test_long_text(documents, prose, tables):
    long = prose(1, words=60_000)
    got = found(documents([(1, long), (2, long[1000:200_000])]), tables)
    assert [g[2] for g in got] == [0, 199_000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=8), st.sampled_from([1, 3, 8, 9, 20, 33]))
def test_suffix_groups(texts, length):
    raw = [t.encode() for t in texts]
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    ends = np.repeat(np.cumsum(sizes), sizes)
    order, groups = suffix.suffix_groups(buffer, ends, length)
    whole = bytes(buffer)
    want = sorted((whole[p : p + length], p) for p in range(len(whole)) if p + length <= ends[p])
    assert [whole[p : p + length] for p in order] == [s for s, _ in want]
    assert sorted(order) == sorted(p for _, p in want)
    strings = [whole[p : p + length] for p in order]
    assert [a == b for a, b in zip(strings, strings[1:])] == [a == b for a, b in zip(groups, groups[1:])]
    prefixes = suffix.common_prefixes(buffer, order, length)
    for a, b, n in zip(strings, strings[1:], prefixes[1:]):
        assert n == next((k for k in range(length) if a[k] != b[k]), length)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.binary(min_size=3, max_size=3), st.integers(0, 9), min_size=1), min_size=1, max_size=4))
def test_merge_by_binary_search(sides):
    arrays = [(np.array(sorted(s), "S3"), np.array([s[k] for k in sorted(s)])) for s in sides]
    names, least = suffix.merge_least(arrays)
    want = {}
    for s in sides:
        for k, v in s.items():
            want[k.rstrip(b"\0")] = min(v, want.get(k.rstrip(b"\0"), v))
    assert dict(zip(names.tolist(), least.tolist())) == want


def sent_anchors(prose, buckets):
    import time

    import pyarrow as pa

    text = prose(1, words=200_000)
    row = {"block": 1, "ids": np.arange(1).tobytes(), "sizes": np.array([len(text)]).tobytes(), "data": text.encode()}
    batch = pa.RecordBatch.from_pylist([row])
    took = []
    for _ in range(3):
        began = time.process_time()
        out = [r for b in repeats._send_anchors(buckets)(iter([batch])) for r in b.to_pylist()]
        took.append(time.process_time() - began)
    return out, min(took)


def test_a_block_is_not_gone_through_once_per_bucket(prose):
    (one, alone), (many, among_many) = sent_anchors(prose, 1), sent_anchors(prose, 3000)
    assert len(one) == 1 and len(many) > 2500
    assert sum(len(r["codes"]) for r in many) >= len(one[0]["codes"])  # in one bucket more codes are the same
    assert among_many < 3 * alone + 0.05


def test_only_pieces_with_a_common_anchor_are_sorted(monkeypatch):
    sorted_bytes = []
    groups = suffix.suffix_groups
    monkeypatch.setattr(suffix, "suffix_groups", lambda text, *a: sorted_bytes.append(len(text)) or groups(text, *a))
    a, b, c = (bytes(range(k, k + 60)) for k in (0, 5, 100))  # a and b have 55 bytes in common, c stands in two documents
    text = np.frombuffer(a + b + c, np.uint8)
    bucket = repeats.Bucket(np.array([60, 60, 60]), text, np.array([7, 7, 8], "<u4"))
    place, start, size = bucket.ranges(np.array([2, 1, 4, 3]), np.array([0, 100, 200, 300]), np.array([1, 1, 2]))
    assert sorted_bytes == [120]
    assert sorted(zip(place.tolist(), start.tolist(), size.tolist())) == [(0, 5, 55), (2, 200, 60)]
