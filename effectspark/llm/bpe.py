"""Byte-level BPE encoding by merge replay, and decoding.

A task keeps the distinct words of its texts as one small corpus. An inverted
index leads from the rank of a token pair to all positions where the pair stands;
ranks are replayed in ascending order, each over all its positions at once, and
after a merge only the two pairs that touch it are entered anew; which tokens merge
with a token is listed once per worker. A word is replayed once per worker for as long
as it is kept; texts are then put together from their words.

Nothing is shuffled, and a task holds one batch of texts, its words, and at most
``CACHED_WORDS`` words of earlier batches.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHED_WORDS = 300_000
LONG_TEXT = 1 << 20  # characters; longer texts are matched in blocks of words
BLOCK = 200_000  # words or ids handled at once in a long text
_ID_BITS = 24
_CODE = np.dtype("<u4")


class ByteBPE:
    """Encoder and decoder for one rank table (token bytes -> id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank table lacks single bytes: {missing[:5]}")
        if max(ranks.values()) >= 1 << _ID_BITS:
            raise ValueError("token ids are too large")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # ranks of merges: of two bytes; by the left token those of each right one, and the other way round
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        self.followers: dict[int, dict[int, int]] = {}
        self.leaders: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.followers.setdefault(left, {})[right] = rank
                    self.leaders.setdefault(right, {})[left] = rank
        self.pattern = regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the new words of several texts are replayed as one corpus."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            if len(texts[start]) > LONG_TEXT:
                out.append(self._encode_long(texts[start]))
                start += 1
                continue
            stop, held = start, 0
            while stop < len(texts) and (held := held + len(texts[stop])) <= LONG_TEXT:
                stop += 1
            split = list(map(self.pattern.findall, texts[start:stop]))
            self._replay_new(set().union(*split))
            out += [b"".join(map(self.words.__getitem__, words)) for words in split]
            start = stop
        return out

    def _encode_long(self, text: str) -> bytes:
        found = (m.group() for m in self.pattern.finditer(text))
        parts = []
        while words := list(islice(found, BLOCK)):
            self._replay_new(set(words))
            parts.append(b"".join(map(self.words.__getitem__, words)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        codes, tokens = np.frombuffer(ids, _CODE), self.tokens
        return b"".join(
            b"".join([tokens[i] for i in codes[start : start + BLOCK].tolist()]) for start in range(0, len(codes), BLOCK)
        )

    def _replay_new(self, words: set[str]) -> None:
        if len(self.words) > CACHED_WORDS // 2:  # words met since then are kept, the others go
            self.words, self.older = {}, self.words
        new = list(words.difference(self.words))
        if self.older:
            self.words.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.older]
        texts = [w.encode() for w in new]
        # a word that is a token itself needs no merges
        whole = [self.ranks.get(t) for t in texts]
        self.words.update((w, i.to_bytes(4, "little")) for w, i in zip(new, whole) if i is not None)
        rest = [(w, t) for w, t, i in zip(new, texts, whole) if i is None]
        if rest:
            self.words.update(zip((w for w, _ in rest), self._replay([t for _, t in rest])))

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        start_ids = self.byte_ids[raw]
        size = len(start_ids)
        last = np.zeros(size, bool)
        last[ends - 1] = True
        nxt_at = np.where(last, -1, np.arange(1, size + 1))
        prv_at = np.arange(-1, size - 1)
        prv_at[ends[:-1]] = -1

        at = np.flatnonzero(~last)
        ranks = self.byte_pairs[raw[at], raw[at + 1]]
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        found, first = np.unique(ranks[order], return_index=True)
        index = {r: part.tolist() for r, part in zip(found.tolist(), np.split(at[order], first[1:]))}
        rank_at = np.full(size, -1)  # of the pair that starts here now
        rank_at[at] = ranks

        none: dict[int, int] = {}
        ids, nxt, prv, now = start_ids.tolist(), nxt_at.tolist(), prv_at.tolist(), rank_at.tolist()
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            followed, led = self.followers.get(rank, none).get, self.leaders.get(rank, none).get
            for done, p in enumerate(positions, 1):
                if now[p] != rank:
                    continue
                q, before = nxt[p], prv[p]
                after = nxt[q]
                ids[p], ids[q], now[q], nxt[p] = rank, -1, -1, after
                sooner, new = False, -1
                if after >= 0:
                    prv[after] = p
                    new = followed(ids[after], -1)
                    if new >= 0:
                        sooner = new <= rank
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(queue, new)
                now[p] = new
                if before >= 0:
                    new = now[before] = led(ids[before], -1)
                    if new >= 0:
                        sooner |= new <= rank
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(queue, new)
                if sooner and done < len(positions):  # its turn comes before the rest of this rank
                    if rank not in index:
                        index[rank] = []
                        heappush(queue, rank)
                    index[rank].extend(positions[done:])
                    break

        final = np.array(ids, dtype=np.int64)
        alive = final >= 0
        stops = np.cumsum(alive)[ends - 1] * _CODE.itemsize
        out = final[alive].astype(_CODE).tobytes()
        return [out[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


def read_ranks(path: str) -> bytes:
    """The rank file's content: lines of base64 token and id. Its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(1)
def _coder(content: bytes, pattern: str) -> ByteBPE:
    ranks = {base64.b64decode(token): int(i) for token, i in (line.split() for line in content.splitlines() if line)}
    return ByteBPE(ranks, pattern)


class _Coder:
    """Hands the rank table to the tasks once; a worker keeps its coder from task to task."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        self.content = spark.sparkContext.broadcast(read_ranks(ranks_path))
        self.pattern = pattern

    def __call__(self) -> ByteBPE:
        return _coder(self.content.value, self.pattern)


def _map(docs: DataFrame, new: dict[str, str], change: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """``docs`` with binary columns added (or replaced) by ``change``, batch by batch."""
    kept = [c for c in docs.columns if c not in new]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = change(batch)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + list(values.values())
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *values])

    schema = docs.select(*kept).schema
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(task, schema)


def _encode_all(coder: ByteBPE, column: pa.Array) -> list[bytes]:
    return coder.encode_all([t or "" for t in column.to_pylist()])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of ``text``, as little-endian unsigned 32-bit integers in a binary column.

    Each match of ``pattern`` is encoded by itself, without special tokens. A NULL text
    has no ids, like an empty one. Other columns pass through; one named like ``ids`` is
    replaced. Rows are independent, so ties and repeated rows need no rule.
    """
    coder = _Coder(docs.sparkSession, ranks_path, pattern)
    return _map(docs, {ids: "binary"}, lambda b: {ids: pa.array(_encode_all(coder(), b.column(text)), pa.binary())})


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; NULL ids decode to no bytes. An unknown id is an error."""
    coder = _Coder(df.sparkSession, ranks_path, pattern)

    def change(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = coder()
        return {decoded: pa.array([bpe.decode(i or b"") for i in batch.column(ids).to_pylist()], pa.binary())}

    return _map(df, {decoded: "binary"}, change)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one task: adds ``ids`` and ``decoded``."""
    coder = _Coder(docs.sparkSession, ranks_path, pattern)

    def change(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = coder()
        codes = _encode_all(bpe, batch.column(text))
        return {"ids": pa.array(codes, pa.binary()), "decoded": pa.array(map(bpe.decode, codes), pa.binary())}

    return _map(docs, {"ids": "binary", "decoded": "binary"}, change)
