"""Removal of repeated substrings by suffix arrays over shards.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document
with a smaller doc_id. Strings that are equal must meet in one shard, without moving
every string. Each string belongs to its *anchor*, the least hash among its ANCHOR-byte
substrings, which is the same wherever the string stands; consecutive strings with one
anchor travel as one piece of text.

1. Documents are packed into blocks of bounded size, written once.
2. Anchors are exchanged as numbers only, and those found in a single document drop
   out: their strings cannot be repeats.
3. The pieces of the other anchors, once per block whatever its number of copies, go
   to the bucket of their anchor. There, shards of bounded size are sorted as suffix
   arrays, equal neighbours found from common prefixes, and shards merged by binary
   search; every string learns the least doc_id it starts in.
4. The ranges to remove return to the blocks, which cut them out.

Rows between blocks and buckets are many and small, so the tasks make and read them as whole
arrays, never one by one, and there are as many buckets as the text that moves needs.

Very frequent anchors, such as those at the edge of a line that a third of all
documents hold, are followed by ever different text. Their strings travel one by one
and are dealt out by their own hash, so that no bucket has to hold them all.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.llm import suffix
from effectspark.llm.suffix import order_of
from effectspark.llm.tables import partitions
from effectspark.sources.store import Workspace

LENGTH = 50
ANCHOR = 20
WINDOW = LENGTH - ANCHOR + 1  # anchors in a string
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20  # of text per bucket: of all text when anchors are judged, then of the pieces that move
SHARD_BYTES = 1 << 20
FREQUENT = 10_000  # pieces of one anchor, counted once per block, beyond which its strings travel one by one
BATCH_ROWS = 8  # blocks are large rows
STEP = 1 << 16  # strings whose anchors are found at a time: their arrays stay in the processor's cache
NO_ID = np.iinfo(np.int64).max  # a NULL doc_id is greater than all others

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHARED, OFTEN = 1, 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, made once for the longest buffer so far."""

    def __init__(self, base: int):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, KEPT_POWERS)
            tables = []
            for base in self.bases:
                table = np.full(size, base)
                table[0] = 1
                tables.append(np.multiply.accumulate(table, out=table))
            if n > KEPT_POWERS:
                return [t[:n] for t in tables]
            self.tables = tables
        return [t[:n] for t in self.tables]


KEPT_POWERS = (2 << 20) + (1 << 18)  # somewhat more than a usual block
_POWERS = [_Powers(base) for base in _BASES]


class Rolling:
    """Hashes of any substrings of a buffer, from running sums of byte times power."""

    def __init__(self, buffer: np.ndarray, which: int = 0):
        power, self.back = _POWERS[which](len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        """Hashes of ``buffer[start:stop]``, for arrays of equal length."""
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes, not yet mixed, of all substrings of one width."""
        n = len(self.sums) - width
        out = self.sums[width:] - self.sums[:n]
        out *= self.back[:n]
        return out


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values."""
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Runs:
    """Runs of consecutive strings with one anchor: strings start in [first, last], all in one document."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    owner: np.ndarray  # index of the document


def find_runs(buffer: np.ndarray, sizes: np.ndarray) -> Runs:
    n = len(buffer) - LENGTH + 1  # strings
    empty = np.zeros(0, np.int64)
    if n < 1:
        return Runs(empty, empty, empty.astype(np.uint64), empty)
    # a run starts where the anchor changes, at each document's start, and past its last string
    stops = np.cumsum(sizes)
    begins = stops - sizes
    edges = np.unique(np.concatenate([begins, np.maximum(begins, stops - LENGTH + 1)]))
    starts, anchors, before = [], [], None
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        least = _least_of(Rolling(buffer[a : b + LENGTH - 1]).every(ANCHOR), WINDOW)
        change = np.empty(b - a, bool)
        change[0] = before is None or least[0] != before
        np.not_equal(least[1:], least[:-1], out=change[1:])
        change[edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a] = True
        at = np.flatnonzero(change)
        starts.append(at + a)
        anchors.append(least[at])
        before = least[-1]
    first = np.concatenate(starts)
    last = np.append(first[1:], n) - 1
    own = np.searchsorted(stops, first, "right")
    held = first + LENGTH <= stops[own]
    return Runs(first[held], last[held], _mixed(np.concatenate(anchors)[held]), own[held])


def _heads(*ordered: np.ndarray) -> np.ndarray:
    """Whether an item differs from the one before it, in any of these arrays."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for values in ordered:
        new[1:] |= values[1:] != values[:-1]
    return new


@dataclass
class Codes:
    """The distinct anchors of a block's runs by bucket, as numbers of 32 bits."""

    order: np.ndarray  # runs sorted by (bucket, code)
    number: np.ndarray  # which code each of these has
    codes: np.ndarray
    runs: np.ndarray  # runs of each code (at most 127), and 128 more if in several documents
    buckets: np.ndarray
    cuts: np.ndarray  # where the codes of each bucket begin, and the last end


@dataclass
class Block:
    """A block's text, its documents and its runs, the same whenever it is worked out."""

    ids: np.ndarray
    sizes: np.ndarray
    buffer: np.ndarray

    def __post_init__(self) -> None:
        self.runs = find_runs(self.buffer, self.sizes)

    def codes(self, buckets: int) -> Codes:
        low = np.uint64(32)
        key = ((self.runs.anchor >> low) % np.uint64(buckets)) << low | self.runs.anchor & np.uint64(0xFFFFFFFF)
        order = order_of(key, 32 + buckets.bit_length())
        key, owner = key[order], self.ids[self.runs.owner[order]]
        new = _heads(key)
        at = np.flatnonzero(new)
        counts = np.minimum(np.diff(at, append=len(key)), 127)
        several = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at) if len(at) else np.zeros(0, bool)
        names = key[at]
        bucket = (names >> low).astype(np.int32)
        begins = np.flatnonzero(_heads(bucket))
        return Codes(
            order, np.cumsum(new) - 1, names.astype("<u4"), (counts + 128 * several).astype(np.uint8),
            bucket[begins], np.append(begins, len(names)),
        )

    def pieces(self, buckets: int, found: np.ndarray, verdict: np.ndarray, places: int) -> "Pieces":
        """The pieces of shared anchors, dealt to ``places`` buckets, given a verdict for each code of the buckets ``found``."""
        codes = self.codes(buckets)
        at = np.searchsorted(codes.buckets, found)
        judged = np.zeros(len(codes.codes), np.uint8)
        judged[_ranges(codes.cuts[at], np.diff(codes.cuts)[at])] = verdict
        kind = np.empty(len(codes.order), np.uint8)
        kind[codes.order] = judged[codes.number]
        runs, whole, single = self.runs, kind == SHARED, kind == OFTEN
        count = runs.last[single] - runs.first[single] + 1
        alone = _ranges(runs.first[single], count)
        rolling = Rolling(self.buffer)
        starts = np.concatenate([runs.first[whole], alone])
        stops = np.concatenate([runs.last[whole] + LENGTH, alone + LENGTH])
        owner = np.concatenate([runs.owner[whole], np.repeat(runs.owner[single], count)])
        route = np.concatenate([runs.anchor[whole], rolling.of(alone, alone + LENGTH)])
        return Pieces(self, rolling, starts, stops, owner, route, places)


class Pieces:
    """A block's pieces by bucket; of equal ones the first stands for all."""

    def __init__(self, block: Block, rolling: Rolling, starts, stops, owner, route, buckets: int):
        self.block = block
        bucket = ((route >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        first, number = _distinct(_names(block.buffer, rolling, starts, stops))
        rank = np.empty(len(first), np.int64)
        order = order_of(bucket[first], buckets.bit_length())
        rank[order] = np.arange(len(order))
        number = rank[number]
        self.by_number = order_of(number, 32)
        self.starts, self.ids = starts[self.by_number], block.ids[owner[self.by_number]]
        self.copies = np.bincount(number, minlength=len(order))
        self.first, self.sizes = starts[first[order]], (stops - starts)[first[order]]
        self.codes = route[first[order]].astype("<u4")
        ranked = bucket[first[order]]
        self.cuts = np.flatnonzero(_heads(ranked))
        self.buckets = ranked[self.cuts].astype(np.int32)
        self.cuts = np.append(self.cuts, len(ranked))

    def text(self) -> np.ndarray:
        """The bytes of all different pieces."""
        return self.block.buffer[_ranges(self.first, self.sizes)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``starts`` and have ``sizes`` members."""
    skipped = np.cumsum(sizes) - sizes
    return np.repeat(starts - skipped, sizes) + np.arange(int(sizes.sum()))


def _names(buffer: np.ndarray, rolling: Rolling, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """A name of 128 bits and the length for each substring: equal names, equal bytes."""
    return [rolling.of(starts, stops), Rolling(buffer, 1).of(starts, stops), stops - starts]


def _distinct(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct name, and the number of each name."""
    some = names[0] >> np.uint64(24)
    order = order_of(some, 40)
    new = _heads(some[order])
    if (_heads(*[n[order] for n in names]) != new).any():  # names that differ agree in these bits
        order = np.lexsort(names[::-1])
        new = _heads(*[n[order] for n in names])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Bucket:
    """The pieces of a bucket as they were sent, each with a code: pieces that share a string have one code."""

    def __init__(self, sizes: np.ndarray, text: np.ndarray, codes: np.ndarray):
        starts = np.cumsum(sizes) - sizes
        first, self.number = _distinct(_names(text, Rolling(text), starts, starts + sizes))
        self.text, self.starts, self.sizes = text, starts[first], sizes[first]
        order = order_of(codes[first], 32)
        at = np.flatnonzero(_heads(codes[first][order]))
        counts = np.diff(at, append=len(order))
        self.several = np.sort(order[np.repeat(counts > 1, counts)])
        self.alone = order[np.repeat(counts == 1, counts)]

    def runs(self, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs (distinct piece, first string, strings, least doc_id), by piece; ``doc`` is the least doc_id of each.

        A piece that is alone with its code has no string in common with another one; the others are sorted.
        """
        piece, first, strings, least = self._sorted(doc) if len(self.several) else [np.zeros(0, np.int64)] * 4
        piece = np.concatenate([piece, self.alone])
        first = np.concatenate([first, np.zeros(len(self.alone), np.int64)])
        strings = np.concatenate([strings, self.sizes[self.alone] - LENGTH + 1])
        least = np.concatenate([least, doc[self.alone]])
        order = order_of(piece, 32)
        return piece[order], first[order], strings[order], least[order]

    def _sorted(self, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs of the pieces that are not alone."""
        starts, sizes, doc = self.starts[self.several], self.sizes[self.several], doc[self.several]
        # shards: consecutive distinct pieces of about SHARD_BYTES
        cuts = np.flatnonzero(_heads(np.cumsum(sizes) // SHARD_BYTES))
        solved = []
        for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
            solved.append(_Shard(self.text[_ranges(starts[a:b], sizes[a:b])], sizes[a:b], doc[a:b]))
        names, least = suffix.merge_least([(s.names, s.least) for s in solved])
        least = np.concatenate([s.lookup(names, least) for s in solved])  # per piece and string
        strings = sizes - LENGTH + 1
        begin = np.cumsum(strings) - strings
        new = _heads(least)
        new[begin] = True
        head = np.flatnonzero(new)
        piece = np.searchsorted(begin, head, "right") - 1
        return self.several[piece], head - begin[piece], np.diff(head, append=len(least)), least[head]

    def ranges(self, ids: np.ndarray, starts: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
        """Byte ranges (place, start, size) that lie in strings which start in a smaller document.

        A place is where a piece stands: ``copies`` of each piece that was sent, in turn,
        with the doc_id and the start in its block.
        """
        piece = np.repeat(self.number, copies)
        doc = np.full(len(self.sizes), NO_ID)
        np.minimum.at(doc, piece, ids)
        which, first, strings, least = self.runs(doc)
        held = np.bincount(which, minlength=len(self.sizes))
        begin = np.cumsum(held) - held
        row = _ranges(begin[piece], held[piece])
        place = np.repeat(np.arange(len(piece)), held[piece])
        later = least[row] < ids[place]
        row, place = row[later], place[later]
        return place, starts[place] + first[row], strings[row] + LENGTH - 1


class _Shard:
    """A suffix array over some pieces: its distinct strings in order, and the least doc_id of each."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        stops = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        order, _ = suffix.suffix_groups(text, stops[piece], LENGTH)
        new = suffix.common_prefixes(text, order, LENGTH) < LENGTH
        new[:1] = True
        self.heads = order[new]
        number = np.cumsum(new) - 1
        self.least = np.full(len(self.heads), NO_ID)
        np.minimum.at(self.least, number, docs[piece[order]])
        self.names = suffix.strings(text, self.heads, LENGTH)
        # in text order: all starts but the last LENGTH - 1 of each piece
        self.number_of = number[order_of(order, len(text).bit_length())]

    def lookup(self, names: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The merged least doc_id of each string, in text order."""
        return least[np.searchsorted(names, self.names)][self.number_of]


def remove_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), a row per input row.

    ``kept`` holds the remaining bytes, ``spans`` the removed ones as maximal runs of
    byte offsets [start, end). Texts are taken as UTF-8, whole; a NULL text is empty.
    Only smaller doc_ids count, so rows that repeat a doc_id leave each other alone; a
    NULL doc_id is greater than all others. Texts under LENGTH bytes lose nothing.
    Other columns are ignored. Memory grows with the longest single text.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    name = f"text_blocks_{uuid.uuid4().hex}"
    count = 2 * partitions(spark)
    _blocks(docs).write.option("path", ws.path("blocks")).option("compression", "zstd").bucketBy(
        count, "block"
    ).format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))

    verdicts = blocks.select(*_BLOCK).mapInArrow(_send_anchors(buckets), "bucket int, block bigint, codes binary, runs binary")
    verdicts = verdicts.groupBy("bucket").applyInArrow(
        _judge_anchors, "block bigint, bucket int, verdict binary, bytes bigint"
    )
    verdicts = ws.save(
        verdicts.groupBy("block").agg(F.collect_list(F.struct("bucket", "verdict")).alias("verdicts"), F.sum("bytes").alias("bytes")),
        "verdicts",
    ).df
    moved = verdicts.agg(F.sum("bytes")).first()[0] or 0
    sent = blocks.select(*_BLOCK).join(verdicts.select("block", "verdicts"), "block").mapInArrow(
        _send_pieces(buckets, max(1, math.ceil(moved / BUCKET_BYTES))),
        "bucket int, block bigint, sizes binary, codes binary, text binary, copies binary, starts binary, docs binary",
    )
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block bigint, answer binary")
    answers = ws.save(answers.groupBy("block").agg(F.collect_list(F.struct("answer")).alias("answers")), "answers").df
    return blocks.select(*_BLOCK).join(answers, "block", "left").mapInArrow(
        _cut(), "doc_id bigint, n_bytes bigint, n_removed bigint, "
                "spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


_BLOCK = ("block", "ids", "named", "sizes", "data")


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of about BLOCK_BYTES of text: the documents' ids and sizes as number arrays, and their bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            named = np.array([i is not None for i in ids], np.uint8)
            values = {
                "block": uuid.uuid4().int >> 65,
                "ids": np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(),
                "named": named.tobytes(),
                "sizes": np.array([len(t) for t in texts], np.int64).tobytes(),
                "data": b"".join(texts),
                "bytes": held,
            }
            return pa.RecordBatch.from_pylist([values])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                if ids and held + len(raw) > BLOCK_BYTES:
                    yield row()
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(task, "block bigint, ids binary, named binary, sizes binary, data binary, bytes bigint")


def _block(row: dict) -> Block:
    return Block(
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["data"], np.uint8)
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a block's arrays are gone before the next one's are made."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _items(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` from each cut to the next."""
    offsets = np.ascontiguousarray(cuts * values.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(items: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers that binary values hold, one after the other, and how many each holds."""
    kind, values, counts = np.dtype(kind), [], []
    for part in items.chunks if isinstance(items, pa.ChunkedArray) else [items]:
        _, offsets, data = part.buffers()
        wide = np.int64 if pa.types.is_large_binary(part.type) else np.int32
        cuts = np.frombuffer(offsets, wide)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        size = int(cuts[-1] - cuts[0])
        values.append(np.frombuffer(data, kind, size // kind.itemsize, int(cuts[0])) if size else np.zeros(0, kind))
        counts.append(np.diff(cuts) // kind.itemsize)
    return np.concatenate(values or [np.zeros(0, kind)]), np.concatenate(counts or [np.zeros(0, np.int64)])


def _cuts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _send_anchors(buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = _block(row).codes(buckets)
            if len(found.buckets):
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(found.buckets),
                    "block": pa.array(np.full(len(found.buckets), row["block"], np.int64)),
                    "codes": _items(found.codes, found.cuts),
                    "runs": _items(found.runs, found.cuts),
                })

    return task


def _judge_anchors(table: pa.Table) -> pa.Table:
    """Per block and anchor: 0, SHARED (in several documents) or OFTEN (in very many); and about how many bytes will move."""
    codes, lengths = _joined(table["codes"], "<u4")
    flags, _ = _joined(table["runs"], "u1")
    order = order_of(codes, 32)
    new = _heads(codes[order])
    at = np.flatnonzero(new)
    flags = flags[order]
    runs = np.add.reduceat((flags & 127).astype(np.int64), at)
    several = (np.maximum.reduceat(flags, at) > 127) | (np.diff(at, append=len(codes)) > 1)  # a block has a code once
    verdict = (np.where(runs >= FREQUENT, OFTEN, SHARED) * several).astype(np.uint8)
    own = np.empty(len(codes), np.uint8)
    own[order] = verdict[np.cumsum(new) - 1]
    each = np.array([0, LENGTH + WINDOW // 2, LENGTH * (WINDOW // 2)])
    size = np.empty(len(codes), np.int64)
    size[order] = flags & 127
    size *= each[own]
    begin = _cuts(lengths)[:-1]
    told = np.maximum.reduceat(own, begin) > 0
    kept = own[np.repeat(told, lengths)]
    return pa.table({
        "block": table["block"].filter(pa.array(told)),
        "bucket": table["bucket"].filter(pa.array(told)),
        "verdict": _items(kept, _cuts(lengths[told])),
        "bytes": pa.array(np.add.reduceat(size, begin)[told]),
    })


def _send_pieces(buckets: int, places: int = 0):
    """``places``: buckets of the pieces, as many as of the anchors if not given."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = batch.column("verdicts")
            for i, row in enumerate(_rows([batch.drop_columns("verdicts")])):
                given = verdicts[i].values
                if given is None or not len(given):
                    continue
                verdict, _ = _joined(given.field("verdict"), "u1")
                found = given.field("bucket").to_numpy(zero_copy_only=False)
                pieces = _block(row).pieces(buckets, found, verdict, places or buckets)
                place = _cuts(pieces.copies)[pieces.cuts]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(pieces.buckets),
                    "block": pa.array(np.full(len(pieces.buckets), row["block"], np.int64)),
                    "sizes": _items(pieces.sizes.astype("<u4"), pieces.cuts),
                    "codes": _items(pieces.codes, pieces.cuts),
                    "text": _items(pieces.text(), _cuts(pieces.sizes)[pieces.cuts]),
                    "copies": _items(pieces.copies.astype("<u4"), pieces.cuts),
                    "starts": _items(pieces.starts.astype("<u4"), place),
                    "docs": _items(pieces.ids.astype("<i8"), place),
                })

    return task


def _answer(table: pa.Table) -> pa.Table:
    """Per block the byte ranges to remove, as (start, size) in turn."""
    sizes, copies, starts = (_joined(table[c], "<u4")[0].astype(np.int64) for c in ("sizes", "copies", "starts"))
    codes, text = _joined(table["codes"], "<u4")[0], _joined(table["text"], "u1")[0]
    docs, sent = _joined(table["docs"], "<i8")
    place, start, size = Bucket(sizes, text, codes).ranges(docs, starts, copies)
    row = np.searchsorted(np.cumsum(sent), place, "right")
    counts = np.bincount(row, minlength=len(sent))
    told = counts > 0
    return pa.table({
        "block": table["block"].filter(pa.array(told)),
        "answer": _items(np.stack([start, size], axis=1).astype("<u4").ravel(), 2 * _cuts(counts[told])),
    })


def _cut(_buckets: int = 0):
    """Ranges come with their place in the block: it makes no difference how many buckets there were."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers")
            for i, row in enumerate(_rows([batch.drop_columns("answers")])):
                sizes, data = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["data"], np.uint8)
                gone, given = np.zeros(len(data), bool), answers[i].values
                if given is not None and len(given):
                    ranges, _ = _joined(given.field("answer"), "<u4")
                    start, size = ranges[::2].astype(np.int64), ranges[1::2].astype(np.int64)
                    marks = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + size, minlength=len(data) + 1)
                    gone = np.cumsum(marks)[:-1] > 0
                yield _remains(row, sizes, data, gone)

    return task


def _remains(row: dict, sizes: np.ndarray, data: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of a block's documents without the bytes that are ``gone``."""
    ids, named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], np.uint8)
    cuts = _cuts(sizes)
    # a span starts where a removed byte follows one that stays or stands first in its document
    before = np.concatenate([[False], gone[:-1]])
    after = np.concatenate([gone[1:], [False]])
    begins, ends = cuts[:-1][sizes > 0], cuts[1:][sizes > 0] - 1
    before[begins] = False
    after[ends] = False
    starts, stops = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    own = np.searchsorted(cuts[1:], starts, "right")
    removed = _cuts(gone)[cuts]
    spans = pa.StructArray.from_arrays([pa.array(starts - cuts[own]), pa.array(stops - cuts[own])], ["start", "end"])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, mask=named == 0),
        "n_bytes": pa.array(sizes),
        "n_removed": pa.array(np.diff(removed)),
        "spans": pa.ListArray.from_arrays(pa.array(_cuts(np.bincount(own, minlength=len(sizes))).astype(np.int32)), spans),
        "kept": _items(data[~gone], cuts - removed),
    })
