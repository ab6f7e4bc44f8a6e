"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

With one row of letter counts per word, the product of a block of rows with another
block's transpose gives the squared distances of all their pairs at once. One edit
changes the counts by a squared distance of 1 (insertion, deletion) or 2 (replacement),
so only pairs at most two apart, in blocks of equal or adjacent length, are compared
letter by letter.

Blocks must stay small whatever the vocabulary. The shorter word of a pair is cut in
half: the edit lies in one of the halves, and the other stands in both words at the same
end. Words are blocked by (length, half). A block of more than MOST words is cut again,
inside the half in which its words may differ, until it is small; where nothing is left
to cut, its words differ in one place only, and the alphabet bounds their number. Every
pair is found in exactly one block: the first place where its words differ tells which.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.llm.words import pieces
from effectspark.sources.store import Workspace

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5  # a form is so many times as frequent as its variant
DAMAGED = 199  # one (document, word) in so many loses a letter
MOST = 2048  # words of a block that is not cut again
TILE = 1024  # words whose distances are computed at once
TALLY = 300_000  # distinct words that a task counts before it passes them on
HOPS = 5  # doublings: a chain of forms grows by RATIO a step, and a count is below 5 ** 32

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # of a text in UTF-8, A-Z lower-cased
_LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0xC0, 0x100))  # in Latin-1
_BLOCK = ("size", "head_size", "tail_size", "head", "tail")


def spelling_variants(docs: DataFrame, ws: Workspace, damaged: int | None = DAMAGED) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word.

    Words are the runs of letters (A-Z, a-z and U+00C0 to U+00FF) of all whole texts, A-Z
    lower-cased, of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more.
    With ``damaged``, a run w of document d whose crc32 of ``d:w`` it divides has lost
    one letter first. ``form`` is the most frequent word one edit away (of equal ones the
    least), if it is RATIO times as frequent; ``root`` follows forms to the last.

    NULL and empty texts have no words. A NULL doc_id is empty in ``d:w``. Repeated rows
    count each. Other columns are ignored; an empty table gives no rows.
    """
    words = ws.save(count_words(docs, damaged), "words").df
    pairs = near_pairs(words, ws)
    nearest = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    found = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), nearest.alias("best"))
    near = ws.save(
        found.withColumn("form_n", -F.col("best.rank")).select(
            "word", "n_near",
            F.when(F.col("form_n") >= F.col("n") * RATIO, F.col("best.near")).alias("form"),
            F.when(F.col("form_n") >= F.col("n") * RATIO, F.col("form_n")).alias("form_n"),
        ),
        "near-words",
    ).df
    roots = follow(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), ws)
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )


def count_words(docs: DataFrame, damaged: int | None) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"]):
                raw, prefix = text.as_py(), (name.as_py() or "") + ":"
                if raw:
                    _count(raw.encode().lower(), zlib.crc32(prefix.encode()), damaged, tally)
                if len(tally) > TALLY:
                    yield _tallied(tally)
                    tally.clear()
        yield _tallied(tally)

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _count(raw: bytes, prefix: int, damaged: int | None, tally: Counter) -> None:
    crc32 = zlib.crc32
    for piece in pieces(raw):
        for word, n in Counter(_RUN.findall(piece)).items():
            if len(word) < LEAST_LENGTH:
                continue
            if damaged and (h := crc32(word, prefix)) % damaged == 0:
                letters = word.decode()
                at = h % len(letters)
                word = (letters[:at] + letters[at + 1 :]).encode()
            if len(word) - word.count(b"\xc3") >= LEAST_LENGTH:
                tally[word] += n


def _tallied(tally: Counter) -> pa.RecordBatch:
    words = pa.array(list(tally), pa.binary()).cast(pa.string())
    return pa.record_batch([words, pa.array(list(tally.values()), pa.int64())], ["word", "n"])


def near_pairs(words: DataFrame, ws: Workspace, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that are one edit apart."""
    size = F.length("word")
    # a word is the shorter one in blocks of its own length, the longer one in blocks of one less
    placed = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).withColumns(
        {"head_size": F.lit(0), "tail_size": F.lit(0)}
    )
    done, rows = None, _cut(placed)
    while True:
        full = rows.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("members"))
        full = full.filter((F.col("members") > most) & (F.col("size") - F.col("head_size") - F.col("tail_size") > 1))
        hot = ws.save(full.withColumn("hot", F.lit(True)).drop("members"), "hot-blocks")
        if not hot.rows:
            break
        marked = rows.join(ws.small(hot), list(_BLOCK), "left")
        small = marked.filter("hot IS NULL").drop("hot")
        done = small if done is None else done.unionByName(small)
        rows = ws.save(_cut(marked.filter("hot").drop("hot")), "cut-blocks").df
    rows = rows if done is None else done.unionByName(rows)
    dealt = rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return dealt.mapInArrow(_compare_blocks, "word string, n bigint, near string, near_n bigint")


def _cut(rows: DataFrame) -> DataFrame:
    """Each row in two smaller blocks: one more half of what may differ has to be equal."""
    left = F.col("size") - F.col("head_size") - F.col("tail_size")
    half = F.floor(left / 2).cast("int")
    parts: list[tuple[Column, Column]] = [
        (F.col("head_size") + half, F.col("tail_size")), (F.col("head_size"), F.col("tail_size") + left - half)
    ]
    ways = F.array(*[F.struct(a.alias("head_size"), b.alias("tail_size")) for a, b in parts])
    cut = rows.select("word", "n", "size", F.explode(ways).alias("way")).select("word", "n", "size", "way.*")
    return cut.withColumns({"head": F.expr("left(word, head_size)"), "tail": F.expr("right(word, tail_size)")})


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive one after the other; small ones are packed into one tile."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.table(batch))
        rows += batch.num_rows
        if rows < TILE:
            continue
        table = pa.concat_tables(held).combine_chunks()
        ends = np.flatnonzero(_starts(table))
        last = int(ends[-1])  # the last block may go on
        if last:
            yield from _near(table.slice(0, last))
        held, rows = [table.slice(last)], table.num_rows - last
    if held:
        yield from _near(pa.concat_tables(held).combine_chunks())


def _starts(table: pa.Table) -> np.ndarray:
    """Rows with which a block begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in _BLOCK:
        column = table[name].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return new


def _near(table: pa.Table) -> Iterator[pa.RecordBatch]:
    block = np.cumsum(_starts(table)) - 1
    wanted = np.bincount(block)[block] > 1
    if not wanted.any():
        return
    table, block = table.filter(pa.array(wanted)), block[wanted]
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    counts, letters, lengths = _letter_counts(words)
    short = lengths == table["size"].to_numpy()
    # the pair belongs here only if it differs before the common end; elsewhere the block with the head has it
    limit = np.where(table["tail_size"].to_numpy() == 0, lengths + 1, table["size"].to_numpy() - table["tail_size"].to_numpy())
    norm = (counts * counts).sum(1)
    found = []
    first = 0
    while first < len(words):
        until = min(first + TILE, len(words))
        # a row's partners are in its own block: the columns end with the last block of the rows
        stop = int(np.searchsorted(block, block[until - 1], "right"))
        gram = counts[first:until] @ counts[first:stop].T
        close = norm[first:until, None] + norm[None, first:stop] - 2 * gram <= 2
        close &= block[first:until, None] == block[None, first:stop]
        close &= short[first:until, None] | short[None, first:stop]
        close &= np.arange(first, until)[:, None] < np.arange(first, stop)[None, :]
        a, b = np.nonzero(close)
        found.append(_one_edit(a + first, b + first, letters, lengths, limit))
        first = until
    a, b = (np.concatenate(side) for side in zip(*found))
    word, n = table["word"], table["n"]
    for x, y in ((a, b), (b, a)):
        yield pa.record_batch(
            [word.take(x).combine_chunks(), n.take(x).combine_chunks(), word.take(y).combine_chunks(), n.take(y).combine_chunks()],
            ["word", "n", "near", "near_n"],
        )


def _letter_counts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts per word and letter, the words as padded rows of bytes, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.zeros((len(words), int(lengths.max()) + 2), np.uint8)
    inside = np.arange(letters.shape[1]) < lengths[:, None]
    flat = np.frombuffer(b"".join(words), np.uint8)
    letters[inside] = flat
    place = np.zeros(256, np.int64)
    place[list(_LETTERS)] = np.arange(len(_LETTERS))
    row = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(row * len(_LETTERS) + place[flat], minlength=len(words) * len(_LETTERS))
    return counts.reshape(len(words), len(_LETTERS)).astype(np.float32), letters, lengths


def _one_edit(
    a: np.ndarray, b: np.ndarray, letters: np.ndarray, lengths: np.ndarray, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that differ by one edit and by a place before the limit of their block."""
    good = []
    for s in range(0, len(a), 1 << 17):
        x, y = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
        swap = lengths[x] > lengths[y]
        u, v = np.where(swap, y, x), np.where(swap, x, y)  # v is the longer one, if any is
        differ = letters[u] != letters[v]
        at = differ.argmax(1)
        places = np.arange(letters.shape[1] - 1)
        shifted = (letters[u][:, :-1] != letters[v][:, 1:]) & (places >= at[:, None]) & (places < lengths[u][:, None])
        equal_length = lengths[u] == lengths[v]
        edits = np.where(equal_length, differ.sum(1), 1 + shifted.sum(1))
        good.append((edits == 1) & (at < limit[u]))
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return a[keep], b[keep]


def follow(forms: DataFrame, ws: Workspace) -> DataFrame:
    """(word, root): each word's chain of forms followed to its end, twice as far in each round."""
    links = ws.save(forms, "forms").df
    for _ in range(HOPS):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ws.save(
            links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "forms-followed",
        ).df
        if moved.filter("moved").isEmpty():
            break
        links = moved.drop("moved")
    return links
