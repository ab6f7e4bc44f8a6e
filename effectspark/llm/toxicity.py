"""Toxic spans and document scores from a conditional random field.

Learning runs on a bounded sample of labelled documents. Their labels concern whole
documents, so tokens are labelled first: features that are many times as frequent in
toxic documents as in others are taken greedily until each toxic document is covered by
several, and the tokens that carry one are toxic. A linear-chain CRF learns the tokens'
labels from their words, prefixes and suffixes. Scoring runs over every text, whole: its
forward-backward marginals give the spans, and a logistic regression of their squares' sum
and of the two largest, fitted on the same sample, the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectspark.llm.crf import Chain
from effectspark.sources.store import Workspace

SAMPLE_ROWS = 1500  # different labelled texts per class, the bound of the fit
SAMPLE_BYTES = 32 << 20  # and their bytes per class
BITS = 18
WIDTH = 1 << BITS
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
SUFFIXES = (4,)
PER_TOKEN = 1 + len(PREFIXES) + len(SUFFIXES)
CACHED_WORDS = 100_000
BATCH_ROWS = 64  # texts scored at once
SPAN_FROM = 0.5
TOXIC_FROM = 0.7
# A feature may mark toxic tokens if it stands in LEAST_SHARE of the toxic documents, in LEAST_DOCS at least, and so many
# times as often, by documents and by tokens, in a toxic document as in another; each toxic document is covered up to
# COVER times.
LEAST_DOCS, LEAST_SHARE, DOC_LIFT, TOKEN_LIFT, COVER = 3, 0.02, 4, 20, 8
STEPS, RATE, RIDGE = 60, 1.0, 1e-5
FOLDS = 2  # the document score is fitted on marginals of held-back documents
FIT_TOKENS = 1 << 17  # about as many tokens are worked on at once in the fit

SPANS = "array<struct<start:int,end:int,p:double>>"


def token_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word; a missing one repeats the word's own."""
    own = _slot("w", word)
    long = len(word) > 3
    return [
        own,
        *(_slot("p", word[:n]) if long and len(word) >= n else own for n in PREFIXES),
        *(_slot("s", word[-n:]) if long and len(word) >= n else own for n in SUFFIXES),
    ]


def _slot(kind: str, part: str) -> int:
    return zlib.crc32(f"{kind}{len(part)}{part}".encode()) & (WIDTH - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    chain: Chain
    scale: np.ndarray
    cached: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cached": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.cached
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in {w for w in words if w not in known}:
            slots = list(dict.fromkeys(token_features(w)))
            known[w] = float(self.weights[slots].sum()) + self.bias
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def score(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        """Document score and toxic spans of each text."""
        words = [WORD.findall(t.lower()) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        emission = np.concatenate([self.emissions(w) for w in words]) if len(words) else np.zeros(0)
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(emission), bool)
        first[starts[sizes > 0]] = True
        p = self.chain.marginals(emission, first)
        out = []
        for text, start, size in zip(texts, starts, sizes):
            own = p[start : start + size]
            spans = _spans(text, own) if size and own.max() >= SPAN_FROM else []
            out.append((self.document_score(own), spans))
        return out

    def document_score(self, marginals: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(_sums(marginals) @ self.scale, -LIMIT, LIMIT))))


LIMIT = 30.0


_SUMS = 5


def _sums(p: np.ndarray) -> np.ndarray:
    """What a document's score sees of its marginals: their squares' sum, the two largest, and how sure the largest is.

    Squares, because many tokens that are hardly toxic must not make a long text toxic.
    """
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
    largest = np.partition(p, len(p) - 2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
    return np.array([1.0, np.log1p(p @ p), largest[1], largest[0], -np.log(1.001 - largest[1])])


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens, as offsets into the text; lower-casing that changes lengths is undone by place."""
    lowered = text.lower()
    place = None
    if len(lowered) != len(text):
        place = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    spans: list[dict] = []
    for i, m in enumerate(WORD.finditer(lowered)):
        if p[i] < SPAN_FROM:
            continue
        start, end = m.span()
        if place is not None:
            start, end = int(place[start]), int(place[min(end, len(place)) - 1]) + 1
        if spans and spans[-1]["last"] == i - 1:
            spans[-1] |= {"end": end, "last": i, "p": max(spans[-1]["p"], float(p[i]))}
        else:
            spans.append({"start": start, "end": end, "p": float(p[i]), "last": i})
    return [{k: s[k] for k in ("start", "end", "p")} for s in spans]


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None if a class has no row.

    Per class the ``sample_rows`` different texts with the smallest hashes are taken, as far
    as they have SAMPLE_BYTES together; of copies the document with the least id stands for
    all. NULL labels and documents with contradictory labels are left out. Sample ids
    are bounded by that number, and so are the broadcast of them and the fit.
    """
    clear = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")
    ).filter("toxic = most").select(F.col("doc_id").alias("__id"), "toxic")
    hashed = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("__h"), F.octet_length("text").alias("bytes"))
    texts = hashed.join(clear, F.col("doc_id") == F.col("__id")).groupBy("toxic", "__h").agg(
        F.min("__id").alias("__id"), F.first("bytes").alias("bytes")
    )
    upto = Window.partitionBy("toxic").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
    parts = [texts.filter(F.col("toxic") == y).orderBy("__h").limit(sample_rows) for y in (0, 1)]
    bounded = parts[0].unionByName(parts[1]).withColumn("upto", F.sum("bytes").over(upto)).filter(F.col("upto") <= SAMPLE_BYTES)
    ids = ws.save(bounded.select("__id", "toxic"), "sample-ids").df
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").lower())
                for w in set(words) - known.keys():
                    known[w] = token_features(w)
                out.append(np.array([known[w] for w in words], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("toxic"), pa.array(out, pa.binary())], ["id", "toxic", "slots"]
            )

    sample = ws.save(rows.select("__id", "toxic", "text").mapInArrow(task, "id bigint, toxic int, slots binary"), "sample").df
    # one fit without each fold, and one of all; each is a task that gets the bounded sample
    fits = sample.select("*", F.explode(F.array(*[F.lit(k) for k in range(FOLDS + 1)])).alias("fold"))
    found = {r["fold"]: r for r in fits.groupBy("fold").applyInArrow(_fit_fold, _FITTED).collect()}
    if FOLDS not in found:
        return None
    numbers = lambda raw, kind=np.float64: np.frombuffer(raw, kind)
    held = [r for k, r in found.items() if k < FOLDS] or [found[FOLDS]]  # too few documents to hold any back
    sums = np.concatenate([numbers(r["sums"]).reshape(-1, _SUMS) for r in held])
    scale = _logistic(sums, np.concatenate([numbers(r["toxic"], np.int64) for r in held]))
    whole = found[FOLDS]
    chain = Chain(numbers(whole["start"]).copy(), numbers(whole["move"]).reshape(2, 2).copy())
    return Model(numbers(whole["weights"], np.float32).copy(), whole["bias"], chain, scale)


_FITTED = "fold int, weights binary, bias double, start binary, move binary, sums binary, toxic binary"


def _fit_fold(sample: pa.Table) -> pa.Table:
    """A field learned without one fold of the sample (or from all of it), and what its marginals say of that fold."""
    fold = sample["fold"][0].as_py()
    rows = sorted(zip(sample["id"].to_pylist(), sample["slots"].to_pylist(), sample["toxic"].to_pylist()))
    unique = list({r[1]: r for r in rows if r[1]}.values())  # copies but for case or punctuation teach nothing new
    slots = [np.frombuffer(r[1], np.int32).reshape(-1, PER_TOKEN) for r in unique]
    toxic = np.array([r[2] for r in unique], dtype=np.int64)
    folds = _folds(toxic)
    learn = np.flatnonzero(folds != fold)
    own = np.flatnonzero(folds == fold) if fold < FOLDS else learn
    out = []
    if (toxic[learn] == 1).any() and (toxic[learn] == 0).any() and len(own):
        weights, bias, chain = _field([slots[i] for i in learn], toxic[learn])
        sums = _sums_of([slots[i] for i in own], weights, bias, chain)
        parts = (weights.astype(np.float32), chain.start, chain.move, sums, toxic[own])
        raw = [np.ascontiguousarray(x).tobytes() for x in parts]
        out = [{"fold": fold, "weights": raw[0], "bias": bias, "start": raw[1], "move": raw[2], "sums": raw[3], "toxic": raw[4]}]
    binary = ("weights", "start", "move", "sums", "toxic")
    fields = [("fold", pa.int32()), ("weights", pa.binary()), ("bias", pa.float64()), *[(c, pa.binary()) for c in binary[1:]]]
    return pa.Table.from_pylist(out, pa.schema(fields))


def _frequencies(slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and tokens per feature."""
    stream = np.concatenate([np.zeros((0, PER_TOKEN), np.int32), *slots])
    docs = np.bincount(np.concatenate([np.zeros(0, np.int32), *(np.unique(s) for s in slots)]), minlength=WIDTH)
    # a missing feature repeats the word's own and counts once
    tokens = np.bincount(stream[:, 0], minlength=WIDTH) + np.bincount(stream[:, 1:][stream[:, 1:] != stream[:, :1]], minlength=WIDTH)
    return docs, tokens


def _markers(slots: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic tokens: greedily, each for the documents not yet covered often enough."""
    bad_slots = [s for s, y in zip(slots, toxic) if y]
    (dirty, dirty_tokens), n_dirty = _frequencies(bad_slots), len(bad_slots)
    (clean, clean_tokens), n_clean = _frequencies([s for s, y in zip(slots, toxic) if not y]), len(slots) - n_dirty
    least = min(max(LEAST_DOCS, int(LEAST_SHARE * n_dirty)), max(1, n_dirty // 4))
    usable = (
        (dirty >= least)
        & (dirty * n_clean >= DOC_LIFT * clean * n_dirty)
        & (dirty_tokens * n_clean >= TOKEN_LIFT * clean_tokens * n_dirty)
    )
    bad = [np.unique(s) for s in bad_slots]
    holders: dict[int, list[int]] = {}
    for k, p in enumerate(bad):
        for s in p[usable[p]].tolist():
            holders.setdefault(s, []).append(k)
    covered, marked = np.zeros(len(bad), int), np.zeros(WIDTH, bool)
    lists = {s: np.array(ks) for s, ks in holders.items()}
    while lists:
        gains = {s: int((covered[ks] < COVER).sum()) for s, ks in lists.items()}
        best = max(gains, key=lambda s: (gains[s], s))
        if gains[best] < least:
            break
        marked[best] = True
        covered[lists.pop(best)] += 1
    return marked


def _folds(toxic: np.ndarray) -> np.ndarray:
    """Each class dealt out in turn."""
    out = np.zeros(len(toxic), int)
    for y in (0, 1):
        at = np.flatnonzero(toxic == y)
        out[at] = np.arange(len(at)) % FOLDS
    return out


def _parts(slots: list[np.ndarray], toxic: np.ndarray, marked: np.ndarray) -> list[_Part]:
    """Documents are worked on in parts, so that the arrays of a step stay small."""
    sizes = np.array([len(s) for s in slots])
    starts = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(starts // FIT_TOKENS, np.unique(starts // FIT_TOKENS))
    return [_Part(slots[a:b], toxic[a:b], marked) for a, b in zip(cuts, [*cuts[1:], len(slots)])]


def _sums_of(slots: list[np.ndarray], weights: np.ndarray, bias: float, chain: Chain) -> np.ndarray:
    found = []
    for part in _parts(slots, np.zeros(len(slots), int), np.zeros(WIDTH, bool)):
        p = chain.marginals(part.emissions(weights, bias), part.first)
        found += [_sums(own) for own in np.split(p, np.flatnonzero(part.first)[1:])]
    return np.array(found)


def _field(slots: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float, Chain]:
    """Weights, bias and chain that make the tokens' labels likeliest."""
    parts = _parts(slots, toxic, _markers(slots, toxic))
    weights, bias = np.zeros(WIDTH), 0.0
    chain = Chain(np.zeros(2), np.zeros((2, 2)))
    squares = [np.full(WIDTH, 1e-6), 1e-6, np.full(2, 1e-6), np.full((2, 2), 1e-6)]
    n = sum(len(part.stream) for part in parts)
    for _ in range(STEPS):
        gradients = [-RIDGE * weights, 0.0, np.zeros(2), np.zeros((2, 2))]
        for part in parts:
            p, pairs = chain.expectations(part.emissions(weights, bias), part.first)
            miss, first = part.label - p, part.first
            gradients[0] += part.per_slot(miss) / n
            gradients[1] += miss.sum() / n
            gradients[2] += (part.seen_start - np.array([(1 - p[first]).sum(), p[first].sum()])) / n
            gradients[3] += (part.seen_pairs - pairs.sum(2, where=~first)) / n
        values = [weights, bias, chain.start, chain.move]
        for k, g in enumerate(gradients):
            squares[k] = squares[k] + g * g
            values[k] = values[k] + RATE * g / np.sqrt(squares[k])
        weights, bias, chain.start, chain.move = values
    return weights, float(bias), chain


class _Part:
    """Some documents of the sample: their tokens' features and labels."""

    def __init__(self, slots: list[np.ndarray], toxic: np.ndarray, marked: np.ndarray):
        sizes = np.array([len(s) for s in slots])
        self.stream = np.concatenate(slots)
        self.label = marked[self.stream].any(1) & np.repeat(toxic == 1, sizes)
        self.first = np.zeros(len(self.stream), bool)
        self.first[np.cumsum(sizes) - sizes] = True
        # the words are worked on once each, whatever their number of tokens
        self.words, self.word = np.unique(self.stream, axis=0, return_inverse=True)
        self.word = self.word.reshape(-1)
        # a missing feature repeats the word's own and counts once
        self.counts = np.concatenate(
            [np.ones((len(self.words), 1), bool), self.words[:, 1:] != self.words[:, :1]], axis=1
        )
        label, inner = self.label, ~self.first
        before = np.concatenate([[False], label[:-1]])
        self.seen_pairs = np.array(
            [[(~before & ~label & inner).sum(), (~before & label & inner).sum()],
             [(before & ~label & inner).sum(), (before & label & inner).sum()]], float
        )
        self.seen_start = np.array([(~label & self.first).sum(), (label & self.first).sum()], float)

    def emissions(self, weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(self.words), bias)
        for k in range(PER_TOKEN):
            out += np.where(self.counts[:, k], weights[self.words[:, k]], 0.0)
        return out[self.word]

    def per_slot(self, values: np.ndarray) -> np.ndarray:
        total = np.bincount(self.word, values, len(self.words))
        return sum(np.bincount(self.words[:, k], total * self.counts[:, k], WIDTH) for k in range(PER_TOKEN))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model | None, name: str = "score", spans: str = "spans") -> DataFrame:
    """Add the document's score (0 to 1) and its toxic spans (character offsets and the largest marginal).

    Only ``text`` is looked at; a NULL text is an empty one and has no spans. Without a
    model every score is 0. Columns named like the new ones are replaced.
    """
    if model is None:
        return docs.withColumns({name: F.lit(0.0), spans: F.array().cast(SPANS)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights, whatever the data
    kept = [c for c in docs.columns if c not in (name, spans)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                found = model.score([t or "" for t in batch.column("text").to_pylist()])
                columns = [batch.column(c) for c in kept]
                scores, parts = pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], kind)
                yield pa.RecordBatch.from_arrays([*columns, scores, parts], names=[*kept, name, spans])
        model.cached.clear()  # a worker that waits for its next task holds no words

    added = docs.limit(0).withColumns({name: F.lit(0.0), spans: F.array().cast(SPANS)}).select(*kept, name, spans)
    return docs.mapInArrow(task, added.schema)
