"""From raw documents to token digests: five filters and transforms, one after the other.

Each stage gets all rows its predecessor kept, written as Parquet and read again, and
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectspark.llm import decontaminate, line_dedup, near_dedup, toxicity
from effectspark.llm.queries import bpe_digests, toxicity_model
from effectspark.llm.tables import row_key, start, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit; texts that are NULL or empty stay."""
    ws = start(spark, toxicity.BATCH_ROWS)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir, ws), "__score", "__spans")
    return scored.filter(F.col("__score") < toxicity.TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without repeated multi-line passages and ``n_chars`` to match."""
    ws = start(spark)
    found = line_dedup.dedup_lines(docs, ws)
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed.cast("bigint")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates.

    Documents without a word are linked with nothing and stay, as do rows that repeat
    a document that stays.
    """
    ws = start(spark)
    found = near_dedup.near_duplicates(docs, ws)
    gone = found.filter(~F.col("kept")).select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key()).join(gone, "__key", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; texts that are NULL or empty stay."""
    ws = start(spark)
    overlaps = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), ws)
    gone = overlaps.select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key()).join(gone, "__key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each remaining document; a NULL text is an empty one."""
    start(spark)
    return bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

# Neither the random field nor the merge replay can be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder before the next stage reads it."""
    ws = start(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        path = ws.path(name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
