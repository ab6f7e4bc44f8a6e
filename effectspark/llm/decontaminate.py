"""Benchmark passages in documents, found by spaced seeds.

A seed is the hash of the words at the kept places of a mask; it is the same in two
texts that differ only at the ignored places. The seeds of the benchmark items are
joined with those of every window of every document. Around each hit the item is laid
over the document, word by word, and the longest overlap is measured with substitutions
counted; only overlaps that are long and similar enough are reported.

No such overlap is missed. One of 26 words or more can be cut into parts of 13 to 25, of
which one at least is similar enough; one of 14, 16 to 19 or 21 to 24 words holds one of
13, 15 or 20 with as many substitutions. So it is enough that the masks hit 13, 15, 20
and 25 words with any 2, 3, 4 and 5 of them changed, and tests go through them all.

The benchmark is the query set. It goes to the tasks in blocks of bounded size, one
pass over the documents for each, so neither its size nor that of the documents limits
the operator. Documents are not shuffled: only overlaps are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from effectspark.llm.tables import row_key
from effectspark.llm.words import WordCodes
from effectspark.sources.store import Workspace

# The masks (1: the word counts, 0: it is ignored).
MASKS = ("1101111", "110010001011", "110101011", "1110111")
SHORTEST = 5  # words; a shorter item is no evidence and is not searched for
OVERLAP = 13  # words an overlap must span, or the whole of a shorter item
IDENTITY = 0.8  # share of its words that must be equal
BLOCK_BYTES = 4 << 20  # of benchmark text per pass

_PERCENT = round(100 * IDENTITY)
_FILTER_BITS = 20
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """The seed of every window; none if the text is shorter than the mask."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out = out * _FACTOR + codes[k : k + n]
    out ^= out >> np.uint64(32)
    return out * _MIX


def whole_masks(words: int) -> list[str]:
    """Masks over a whole item, one of which hits it with any substitutions allowed: two parts at least are free of them."""
    allowed = words * (100 - _PERCENT) // 100
    parts = np.array_split(np.arange(words), allowed + 2)
    return [
        "".join("1" if any(k in parts[p] for p in kept) else "0" for k in range(words))
        for kept in combinations(range(len(parts)), 2)
    ]


class SeedIndex:
    """Seeds of a block of items, sorted by hash for each mask, behind a filter of fixed size."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.items = [codes for _, codes in items]
        # an item shorter than an overlap is searched for as a whole
        short = sorted({len(c) for c in self.items if len(c) < OVERLAP})
        self.tables = []
        for mask, length in [(m, None) for m in MASKS] + [(m, n) for n in short for m in whole_masks(n)]:
            found = [
                (seeds(c, mask), k) for k, c in enumerate(self.items)
                if (len(c) >= OVERLAP if length is None else len(c) == length)
            ]
            hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
            owner = np.concatenate([np.zeros(0, np.int64), *(np.full(len(h), k) for h, k in found)])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h, _ in found)])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, hashes[order], owner[order], place[order], seen))

    def overlaps(self, codes: np.ndarray) -> dict[int, tuple[int, int]]:
        """Item -> (words of its longest accepted overlap, place in the document)."""
        lines: set[tuple[int, int]] = set()
        for mask, hashes, owner, place, seen in self.tables:
            own = seeds(codes, mask)
            at = np.flatnonzero(seen[own >> np.uint64(64 - _FILTER_BITS)])
            first, stop = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            for p, a, b in zip(at[stop > first].tolist(), first[stop > first].tolist(), stop[stop > first].tolist()):
                lines.update(zip(owner[a:b].tolist(), (p - place[a:b]).tolist()))
        best: dict[int, tuple[int, int]] = {}
        for item, shift in lines:
            words, start = longest(codes, self.items[item], shift)
            if words >= min(OVERLAP, len(self.items[item])):
                best[item] = max(best.get(item, (0, 0)), (words, start))
        return best


def longest(document: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Words and place of the longest stretch, of the item laid over the document from ``shift`` on, with IDENTITY equal words."""
    lo, hi = max(0, -shift), min(len(item), len(document) - shift)
    equal = document[lo + shift : hi + shift] == item[lo:hi]
    # a stretch holds IDENTITY equal words if this sum does not fall over it
    total = np.concatenate([[0], np.cumsum(np.where(equal, 100 - _PERCENT, -_PERCENT))])
    # for each end the first place where the sum was no higher
    first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    words = np.arange(len(total)) - first
    stop = int(np.argmax(words))
    return int(words[stop]), lo + shift + int(first[stop])


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, ws: Workspace, block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST
) -> DataFrame:
    """(key, item_id, words, start): per document and item the longest overlap, in words.

    ``key`` is :func:`row_key` of the document. Items without a text or with fewer than
    ``shortest`` words are not searched for; items may repeat, and are then searched for once.
    Blocks of the benchmark are collected, sent out and freed one after the other.
    """
    spark = docs.sparkSession
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    texts = docs.select(row_key().alias("key"), "text").filter("text IS NOT NULL")
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about block_bytes
        search = _search(shared, to_arrow_type(items.schema["item_id"].dataType), shortest)
        part = ws.save(texts.mapInArrow(search, f"key string, item_id {kind}, words int, start bigint"), "overlaps").df
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _search(shared, kind: pa.DataType, shortest: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = WordCodes(), None
        for batch in batches:
            if index is None:
                index = SeedIndex([(i, c) for i, t in shared.value if len(c := words.plain(t)) >= shortest])
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for item, (count, start) in index.overlaps(words.plain(text)).items():
                    rows.append({"key": key, "item_id": index.ids[item], "words": count, "start": start})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("key", pa.string()), ("item_id", kind), ("words", pa.int32()), ("start", pa.int64())]
                ))

    return task


def contamination(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``longest`` (words) and ``items`` (sorted ids).

    A document without a benchmark passage has 0 items and an empty list; so has one
    with a NULL or empty text, and any document if the benchmark is empty. Columns of
    these names in ``docs`` are replaced; repeated rows get the same answer.
    """
    found = find_overlaps(docs, benchmark, ws)
    per_document = found.groupBy("key").agg(
        F.countDistinct("item_id").alias("__n"), F.max("words").alias("__longest"),
        F.array_sort(F.collect_set("item_id")).alias("__items"), F.count(F.lit(1)).alias("__rows"),
    ).withColumnRenamed("key", "__key")
    results = {
        "contaminated": F.col("__rows").isNotNull(),
        "n_items": F.coalesce("__n", F.lit(0)),
        "longest": F.coalesce("__longest", F.lit(0)),
        "items": F.coalesce("__items", F.array().cast(per_document.schema["__items"].dataType)),
    }
    joined = docs.withColumn("__key", row_key()).join(per_document, "__key", "left")
    return joined.withColumns(results).select(*dict.fromkeys([*docs.columns, *results]))
