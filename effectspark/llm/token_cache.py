"""Token counts through a cache of digests.

A text's key is the digest of its normalised content together with the digest of
the tokenizer. Keys are joined to the stored counts; of the keys that miss, each
distinct one is encoded once and appended. The counts are then joined back.

The cache lasts: it is a list of tables, and an append is a table of its own that is
there from the commit of a new list on. A run that dies adds nothing, and of two runs
that append at once both do. When the list grows long, its tables are merged.

Copies meet as keys only: the distinct misses are chosen by an aggregation, which
keeps one text per key and scan task before anything is shuffled, and the join
back carries no texts; its popular keys are split by the adaptive skew join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.llm.tables import SPACE, text_or_empty
from effectspark.llm.words import pieces
from effectspark.sources.store import Workspace
from effectspark.sources.versions import Versions, VersionTaken

CACHED_WORDS = 300_000
TABLES = 16  # of a cache, beyond which they are merged
CACHE_SCHEMA = "digest binary, n_tokens bigint"


class WordCounter:
    """Counts tokens as the library does, asking it once per distinct word.

    For a tokenizer that drops white space, ASCII white space always ends a word: no
    normalisation, pre-token or special string reaches across it. Words are encoded
    whole by the library, special strings in them handled as it does by default.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        return [sum(self._count(p.split()) for p in pieces(t.encode())) for t in texts]

    def _count(self, words: list[bytes]) -> int:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = list({w for w in words if w not in self.words})
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.words.update((w, len(e.ids)) for w, e in zip(part, found))
        return sum(map(self.words.__getitem__, words))


@lru_cache(1)
def _counter(content: bytes) -> WordCounter:
    return WordCounter(content)


def tokenizer_version(content: bytes) -> str:
    """Digest of the tokenizer file and the library that reads it."""
    import tokenizers

    return hashlib.sha256(content + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()


def token_counts(docs: DataFrame, ws: Workspace, tokenizer_path: str, cache_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row per input row; ``cache_path`` gains the counts it lacked.

    ``tokenizer_path`` is a file of the ``tokenizers`` library, for a tokenizer that drops
    white space. No special tokens are added, nothing is truncated or padded. A NULL text
    counts as empty; doc_ids may be NULL or repeat; other columns are ignored. A cache that
    does not exist yet is empty; runs that append the same key twice do no harm. Tables of the
    cache that are no longer listed are left where they are.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    shared = spark.sparkContext.broadcast(content)  # a vocabulary: its size does not depend on the data
    cache = Versions(spark, f"{cache_path}/{tokenizer_version(content)}")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # the tokenizer drops white space, so its amount does not matter
    texts = texts.withColumn("normal", F.trim(F.regexp_replace("text", SPACE, " ")))
    keyed = texts.withColumn("digest", F.unhex(F.sha2("normal", 256)))
    rows = ws.save(keyed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest"), "keys").df

    distinct = keyed.groupBy("digest").agg(F.first("normal").alias("normal"))
    missing = distinct.join(stored_counts(cache), "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            counts = pa.array(counter.count(batch.column("normal").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], names=["digest", "n_tokens"])

    added = cache.new_folder()
    missing.select("digest", "normal").mapInArrow(count, CACHE_SCHEMA).write.parquet(added)
    if not spark.read.schema(CACHE_SCHEMA).parquet(added).isEmpty():
        _append(cache, added)
    stored = stored_counts(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")


def stored_counts(cache: Versions) -> DataFrame:
    """(digest, n_tokens); a digest that two runs added is there twice."""
    last = cache.latest()
    if last is None:
        return cache.spark.createDataFrame([], CACHE_SCHEMA)
    return cache.spark.read.schema(CACHE_SCHEMA).parquet(*cache.read(last)["tables"])


def _append(cache: Versions, table: str) -> None:
    """Add a table to the list; whoever was faster is read again."""
    while True:
        last = cache.latest()
        tables = [*(cache.read(last)["tables"] if last is not None else []), table]
        if len(tables) > TABLES:
            merged = cache.new_folder()
            all_rows = cache.spark.read.schema(CACHE_SCHEMA).parquet(*tables)
            all_rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(merged)
            tables = [merged]
        with suppress(VersionTaken):
            cache.commit(0 if last is None else last + 1, {"tables": tables})
            return
