import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from effectspark.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def ids_of(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text_as_the_library(library, texts):
    encoding, ranks = library
    coder = bpe.ByteBPE(ranks, PATTERN)
    for t, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids_of(ids) == encoding.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=150),
    st.lists(st.text("abcd", min_size=1, max_size=30), max_size=6),
)
def test_any_rank_table_merges_as_word_by_word(merges, words):
    """Tables in which a merge may rank before the merges that make its parts."""
    tokens = {bytes([b]): 200 + b for b in range(256)}
    parts = [b"a", b"b", b"c", b"d"]
    free = iter(range(200))
    for x, y in merges:
        new = parts[x % len(parts)] + parts[y % len(parts)]
        if new not in tokens and len(new) < 12 and (rank := next(free, None)) is not None:
            tokens[new] = rank
            parts.append(new)
    coder = bpe.ByteBPE(tokens, r"\w+")

    def slow(word):
        if word in tokens:
            return [tokens[word]]
        pieces = [bytes([b]) for b in word]
        while True:
            ranked = [(tokens[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in tokens]
            if not ranked:
                return [tokens[p] for p in pieces]
            _, i = min(ranked)
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]

    coder.encode(" ".join(words))
    for w in words:
        assert ids_of(coder.encode(w)) == slow(w.encode())


def test_table(documents, odd_rows, tables, library):
    encoding, _ = library
    df = documents(odd_rows)
    got = bpe.encode_decode(df, RANKS, PATTERN)
    assert got.columns == [c for c in df.columns if c != "ids"] + ["ids", "decoded"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert ids_of(r.ids) == encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    again = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())


def test_empty_table(documents, tables):
    assert bpe.encode_decode(documents([]), RANKS, PATTERN).count() == 0


def test_long_texts_are_matched_in_blocks(library, monkeypatch, prose):
    encoding, ranks = library
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = prose(3, words=300) + "   \n\n " + "x" * 5000
    coder = bpe.ByteBPE(ranks, PATTERN)
    assert ids_of(coder.encode(text)) == encoding.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def test_a_full_cache_is_emptied(library, monkeypatch, prose):
    encoding, ranks = library
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    coder = bpe.ByteBPE(ranks, PATTERN)
    for i in range(20):
        assert ids_of(coder.encode(prose(i))) == encoding.encode_ordinary(prose(i))
    assert len(coder.words) <= 20 + 61


def test_words_in_use_outlast_a_full_cache(library, monkeypatch):
    """Rare words push out each other, not the words that every text has."""
    encoding, ranks = library
    monkeypatch.setattr(bpe, "CACHED_WORDS", 40)
    coder = bpe.ByteBPE(ranks, PATTERN)
    replayed = []
    replay = coder._replay
    monkeypatch.setattr(coder, "_replay", lambda words: (replayed.extend(words), replay(words))[1])
    for i in range(30):
        text = f"qxzqxz {' '.join(f'zq{i}vj{x}' for x in 'abcdef')}"
        assert ids_of(coder.encode(text)) == encoding.encode_ordinary(text)
    assert replayed.count(b"qxzqxz") == 1
    assert len(coder.words) + len(coder.older) <= 40 + 2 * 20


def test_unknown_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBPE({b"a": 0}, r"\w+")
