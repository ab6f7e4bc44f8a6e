"""The registered queries over the smallest whole tables, against plain versions of their contracts."""

import base64
import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from test_near_dedup import plain as plain_near_duplicates
from tokenizers import Tokenizer

from effectspark.llm import queries


@pytest.fixture(scope="module")
def documents_of(spark, tiny):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


def rows_of(spark, name, folder, key="doc_id"):
    found = queries.queries()[name](spark, folder).collect()
    assert len({r[key] for r in found}) == len(found)
    return {r[key]: r for r in found}


def sha256(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, tiny, documents_of):
    lines = open(public_tokenizers.path(queries.RANKS)).read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(spark, "op1_byte_bpe", tiny)
    assert got.keys() == documents_of.keys()
    for i, text in documents_of.items():
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha256(struct.pack(f"<{len(ids)}I", *ids))
        assert got[i].decoded_sha256 == sha256((text or "").encode())


def test_op3(spark, tiny):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    heads = defaultdict(int)
    for i, raw in pages.items():
        heads[raw] = max(heads[raw], i)
    got = rows_of(spark, "op3_warc", tiny, "page_id")
    for i, raw in pages.items():
        revisit = len(raw) >= 1000 and heads[raw] != i
        want = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", heads[raw] if revisit else None)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    assert got.keys() == pages.keys()


def test_op4(spark, tiny, documents_of):
    first: dict[bytes, int] = {}
    for i in sorted(documents_of):
        raw = (documents_of[i] or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    got = rows_of(spark, "op4_suffix_array", tiny)
    for i, text in documents_of.items():
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(gone), spans, sha256(kept))
    assert sum(r.n_removed for r in got.values()) > 0


def test_op5(spark, small):
    got = rows_of(spark, "op5_toxicity", small)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i, y in labels.items() if got[i].held_out and y is not None]
    caught = sum(got[i].predicted for i in held if labels[i])
    assert caught >= 0.75 * sum(labels[i] for i in held)
    assert sum(got[i].predicted for i in held if not labels[i]) <= 0.1 * caught  # 33 toxic documents to learn from


def test_op6(spark, small):
    got = rows_of(spark, "op6_langid", small)
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    known = {r.lang for r in docs} - {None}
    right = []
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in d.text or "")
        assert 0 <= r.score <= 1 and (r.lang_pred in known if letters else r.lang_pred == "und")
        if r.held_out and d.lang and letters:
            right.append(r.lang_pred == d.lang)
    assert sum(right) >= 0.98 * len(right) > 0


def test_op8(spark, tiny, documents_of):
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    got = rows_of(spark, "op8_token_counts", tiny)
    for i, text in documents_of.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_op9(spark, tiny, documents_of):
    got = rows_of(spark, "op9_near_dedup", tiny)
    want = plain_near_duplicates(list(documents_of.items()))
    assert {(i, r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == set(want)
