import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from effectspark.llm import token_cache
from effectspark.sources.versions import Versions

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_cache.WordCounter(open(PATH, "rb").read())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "́", "é", "'s", "İ",
       "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "1", "!", "漢", "\U0001f389", "a", "B"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=40), st.lists(st.sampled_from(ODD), max_size=25).map("".join)), max_size=4))
def test_words_add_up_to_the_library_s_count(library, counter, texts):
    assert counter.count(texts) == lengths(library, texts)


def test_table(documents, odd_rows, tables, library, tmp_path):
    rows = token_cache.token_counts(documents(odd_rows), tables, PATH, f"file://{tmp_path}/cache").collect()
    counts = lengths(library, [t or "" for _, t in odd_rows])
    want = sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(odd_rows, counts)), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == want


def test_stored_counts_are_used_and_only_misses_added(spark, documents, tables, tmp_path, prose):
    cache = f"file://{tmp_path}/cache"
    count = lambda rows: {r.doc_id: r.n_tokens for r in token_cache.token_counts(documents(rows), tables, PATH, cache).collect()}
    first = count([(1, "a b c"), (2, prose(1))])
    versions = Versions(spark, f"{cache}/{token_cache.tokenizer_version(open(PATH, 'rb').read())}")
    stored = token_cache.stored_counts(versions)
    assert stored.count() == 2
    # a count that is stored is believed: make it recognisable
    changed = versions.new_folder()
    stored.selectExpr("digest", "n_tokens + 1000 AS n_tokens").write.parquet(changed)
    versions.commit_next({"tables": [changed]})
    second = count([(1, " a\tb  c\n"), (2, prose(1)), (3, "new"), (4, "new")])
    assert second == {1: first[1] + 1000, 2: first[2] + 1000, 3: 1, 4: 1}
    assert token_cache.stored_counts(versions).count() == 3
    before = versions.latest()
    assert count([(9, "new"), (8, "a b c")]) == {9: 1, 8: first[1] + 1000}
    assert versions.latest() == before  # nothing was encoded


def test_appends_are_whole_and_merged(spark, documents, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(token_cache, "TABLES", 2)
    cache = f"file://{tmp_path}/cache"
    count = lambda rows: {r.doc_id: r.n_tokens for r in token_cache.token_counts(documents(rows), tables, PATH, cache).collect()}
    versions = Versions(spark, f"{cache}/{token_cache.tokenizer_version(open(PATH, 'rb').read())}")
    for k in range(4):
        assert count([(k, "word " * (k + 1)), (99, "always")]) == {k: k + 1, 99: 1}
        assert len(versions.read(versions.latest())["tables"]) <= 2
    assert token_cache.stored_counts(versions).count() == 5
    with monkeypatch.context() as patch:
        patch.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            count([(1, "never seen before")])
    assert token_cache.stored_counts(versions).count() == 5


def test_the_query_keeps_its_cache(spark, tmp_path):
    from effectspark.llm import queries

    spark.range(30).selectExpr("id AS doc_id", f"concat('{tmp_path.name} ', id % 20) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    first = sorted(map(tuple, queries.op8_token_counts(spark, str(tmp_path)).collect()))
    cache = Versions(spark, f"{queries.token_cache_folder(spark)}/{token_cache.tokenizer_version(open(PATH, 'rb').read())}")
    before = cache.latest()
    again = sorted(map(tuple, queries.op8_token_counts(spark.newSession(), str(tmp_path)).collect()))
    assert again == first and cache.latest() == before is not None


def test_empty_table(documents, tables, tmp_path):
    assert token_cache.token_counts(documents([]), tables, PATH, f"file://{tmp_path}/cache").count() == 0


def test_long_text_is_counted_in_pieces(counter, library, monkeypatch, prose):
    monkeypatch.setattr("effectspark.llm.words.PIECE", 50)
    texts = [prose(i, words=100) + " " * 60 + "x" * 300 for i in range(3)]
    assert counter.count(texts) == lengths(library, texts)
