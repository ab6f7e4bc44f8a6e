import random

import numpy as np
import pytest

from effectspark.llm import langid

SYLLABLES = {"aa": "ka to mi ra", "bb": "sch ung ber lich", "cc": "eau oin que ç"}


def sentence(lang, seed, words=40):
    r = random.Random(seed)
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    return [(i, sentence(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 60)]


@pytest.fixture()
def model(spark, corpus, tables):
    rows = [(t, lang) for i, t, lang in corpus if i % 3] + [("noise", None), (None, "aa"), ("12 34", "bb"), ("", "cc")]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"), tables)


def test_held_out_accuracy(documents, corpus, model, tables):
    rows = langid.predict(documents([(i, t) for i, t, _ in corpus if i % 3 == 0]), model).collect()
    truth = {i: lang for i, _, lang in corpus}
    assert all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in rows)


def test_model(model):
    assert model.languages == ("aa", "bb", "cc")
    assert (model.weights == 0).mean() > 0.5
    assert 0.05 <= model.temperature <= 5


def test_odd_rows(documents, odd_rows, model, tables):
    rows = langid.predict(documents(odd_rows), model).collect()
    assert len(rows) == len(odd_rows)
    texts = {i: t for i, t in odd_rows if i is not None}
    for r in rows:
        letters = any(c.isalpha() for c in texts.get(r.doc_id) or "")
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)


def test_empty_tables(spark, documents, model, tables):
    assert langid.predict(documents([]), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"), tables)
    assert [tuple(r) for r in langid.predict(documents([(1, "abc")]), nothing).collect()] == [(1, "und", 0.0)]


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = sentence("cc", 1, words=500) + " 漢字 🎉 x"
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.ngram_counts(text) == whole).all()
    assert whole.sum() == 3 * len(text)


def test_document_frequencies_cover_all_rows(spark, tables):
    texts = ["ab", "ab", "abc", None, "", "!!"] * 20
    idf = langid._inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    counts = np.array([langid.ngram_counts(t) > 0 for t in texts if t and t != "!!"]).sum(0)
    assert np.allclose(idf, np.log((1 + 60) / (1 + counts)) + 1)


def test_every_language_is_learned_and_too_many_are_refused(spark, tables, monkeypatch):
    rows = [(f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2} " * 5 + str(j), f"l{k:03}") for k in range(300) for j in range(4)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert len(langid.fit(df, tables).languages) == 300
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 299)
    with pytest.raises(ValueError, match="299"):
        langid.fit(df, tables)


def test_the_sample_is_drawn_within_each_language(spark, tables):
    """Copies of one text, however many, are one; a rare language is not thinned out by a frequent one."""
    hot = [("ka to mi ra " * 9, "aa")] * 3000
    rows = hot + [(sentence("aa", k), "aa") for k in range(700)] + [(sentence("bb", k), "bb") for k in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4).withColumn("h", langid.F.xxhash64("text"))
    at, values, y, languages = langid._sample(df, {"aa": 701, "bb": 40}, np.ones(langid.FEATURES), 100)
    assert languages == ("aa", "bb")
    assert list(np.bincount(y)) == [100, 40]
    assert len({(a.tobytes(), v.tobytes()) for a, v in zip(at, values)}) == 140
    least = sorted(df.filter("lang = 'aa'").select("text", "h").distinct().collect(), key=lambda r: r["h"] % (1 << 40))[:100]
    own = {langid.features(langid.ngram_counts(r["text"]), np.ones(langid.FEATURES))[0].tobytes() for r in least}
    assert own == {a.tobytes() for a, k in zip(at, y) if k == 0}
