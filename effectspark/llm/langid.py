"""Language of a text: sparse multinomial logistic regression on character n-grams.

A text becomes counts of hashed 1- to 3-grams of its lower-cased letters, scaled by
1 + log(count) and inverse document frequency and brought to length 1. Document
frequencies come from every training row; the weights are learned on a bounded
sample by follow-the-regularised-leader with an elastic net, which leaves most of
them zero. A temperature fitted on a held-back part of the sample calibrates the
probabilities. Texts are read whole, in blocks of a fixed number of characters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectspark.sources.store import Workspace

BITS = 15
FEATURES = 1 << BITS
ORDERS = 3
BLOCK = 1 << 19  # characters of a long text handled at once
SAMPLE_ROWS = 1500  # different training texts per language, the bound of the fit
MOST_LANGUAGES = 1024  # the model's size depends on it; more languages are refused, none is left out
EPOCHS = 3
HELD_BACK = 5  # every fifth sampled row serves the temperature
UNKNOWN = "und"
# Learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """Code unit of each character of the first plane: itself if a letter, else a blank."""
    codes = np.arange(1 << 16, dtype=np.uint32)
    letters = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    return np.where(letters, codes, np.uint32(32))


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < (1 << 16), _alphabet()[np.minimum(raw, (1 << 16) - 1)], raw)


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without a letter."""
    counts = np.zeros(FEATURES, np.int64)
    tail = np.full(ORDERS - 1, 32, np.uint32)
    any_letter = False
    for start in range(0, len(text), BLOCK):
        part = text[start : start + BLOCK]
        any_letter = any_letter or any(c.isalpha() for c in part)
        codes = np.concatenate([tail, _codes(part)])
        gram = np.zeros(len(codes) - len(tail), np.uint32)
        for n in range(ORDERS):
            shifted = codes[len(tail) - n : len(codes) - n]
            gram = gram * np.uint32(0x01000193) + shifted + np.uint32(1)
            counts += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=FEATURES)
        tail = codes[-len(tail) :]
    return counts if any_letter else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the TF-IDF vector, of length 1."""
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    length = math.sqrt(float(values @ values))
    return at.astype(np.int32), (values / length if length else values).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # languages x FEATURES
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if text and self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        at, values = features(counts, self.idf)
        p = _softmax((self.weights[:, at] @ values + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(training: DataFrame, ws: Workspace, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the columns ``text`` and ``lang``; rows without a language are left out.

    Every language is learned; more than MOST_LANGUAGES are an error. Per language the
    ``sample_rows`` different texts with the least hashes teach, whatever their copies.
    Texts without a letter count for nothing. Without any row to learn from, the model
    predicts UNKNOWN for every text.
    """
    rows = training.filter("lang IS NOT NULL").select("text", "lang")
    hashed = rows.filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    per_language = (
        hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    )
    if len(per_language) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: raise MOST_LANGUAGES, whose size the model has")
    if not per_language:
        return Model((), np.zeros((0, FEATURES)), np.zeros(0), np.ones(FEATURES), 1.0)
    idf = _inverse_frequencies(rows.select("text"))
    at, values, y, languages = _sample(hashed, {r["lang"]: r["n"] for r in per_language}, idf, sample_rows)
    if not languages:
        return Model((), np.zeros((0, FEATURES)), np.zeros(0), np.ones(FEATURES), 1.0)
    held = np.arange(len(y)) % HELD_BACK == HELD_BACK - 1
    weights, bias = _ftrl(at, values, y, np.flatnonzero(~held), len(languages))
    scores = np.array([weights[:, at[i]] @ values[i] + bias for i in np.flatnonzero(held)])
    return Model(languages, weights.astype(np.float32), bias, idf, _temperature(scores, y[held]))


def _inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """From all rows: each task adds up its texts, then the tasks' numbers are summed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text) if text else None
                if counts is not None:
                    total += counts > 0
                    rows += 1
        at = np.flatnonzero(total)
        places, numbers = np.append(at, FEATURES), np.append(total[at], rows)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(numbers, pa.int64())], ["at", "n"])

    found = texts.mapInArrow(task, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(FEATURES + 1)
    frequency[found["at"].to_numpy()] = found["n"].to_numpy()
    return np.log((1.0 + frequency[-1]) / (1.0 + frequency[:-1])) + 1.0


def _sample(rows: DataFrame, sizes: dict[str, int], idf: np.ndarray, most: int):
    """Feature vectors of the ``most`` different texts of each language that have the least hashes."""
    places = 1 << 40
    # a share of the hashes that surely holds enough: the number of texts is known to some percent
    wanted = 1.2 * most + 8 * math.sqrt(most) + 20
    shares = [(lang, min(places, math.ceil(wanted * places / max(1, n)))) for lang, n in sizes.items()]
    limits = F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, share bigint"))
    near = rows.join(limits, "lang").filter(F.pmod("h", F.lit(places)) < F.col("share"))
    distinct = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(places)), "h"))
    chosen = distinct.withColumn("place", place).filter(F.col("place") <= most).select("text", "lang")
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                counts = ngram_counts(text) if text else None
                if counts is not None:
                    at, values = features(counts, shared.value)
                    out.append({"lang": lang, "at": at.tobytes(), "x": values.tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out)

    found = chosen.mapInArrow(task, "lang string, at binary, x binary")
    found = sorted(found.collect(), key=lambda r: (r["x"], r["at"], r["lang"]))  # at most ``most`` rows a language
    languages = tuple(sorted({r["lang"] for r in found}))
    at = [np.frombuffer(r["at"], np.int32) for r in found]
    values = [np.frombuffer(r["x"], np.float32) for r in found]
    return at, values, np.array([languages.index(r["lang"]) for r in found], dtype=int), languages


def _ftrl(at: list, values: list, y: np.ndarray, rows: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; a coordinate is worked out only when a row touches it."""
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(zs: np.ndarray, ns: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(rows):
            places = np.append(at[i], FEATURES)
            x = np.append(values[i], np.float32(1.0))
            zs, ns = z[:, places], n[:, places]
            w = weights(zs, ns, L1)
            w[:, -1] = weights(zs[:, -1], ns[:, -1], 0.0)
            error = _softmax(w @ x)
            error[y[i]] -= 1.0
            g = error[:, None] * x
            squares = g * g
            z[:, places] = zs + g - (np.sqrt(ns + squares) - np.sqrt(ns)) / ALPHA * w
            n[:, places] = ns + squares
    w = weights(z, n, L1)
    return w[:, :-1], weights(z[:, -1], n[:, -1], 0.0)


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the greatest likelihood on the held-back rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(math.log(0.05), math.log(5.0), 93))
    loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(docs: DataFrame, model: Model, doc_id: Column | str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score), a row per input row; no column but ``text`` is looked at.

    A NULL text, or one without a letter, is UNKNOWN with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES x FEATURES weights

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, scores], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id") if isinstance(doc_id, str) else doc_id.alias("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, lang_pred string, score double")
