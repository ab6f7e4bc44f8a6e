"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every scan task yields one run: its rows grouped by digest. Runs are then merged
in rounds, as in a binomial tree: in round r, FAN neighbouring runs become one
(``run >> BITS``), and the aggregation merges their sorted rows. Each level keeps,
per digest, the best row so far and the number of rows it stands for. A group of
copies, however large, reaches a task as at most FAN rows per round, so no group
is ever gathered; the number of rounds is the logarithm of the number of runs.

A digest is trusted only together with a second, independent hash and the length
of the text: the three are the merge key, so rows that agree in one but not in
the others stay apart at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.llm.tables import SPACE, text_or_empty
from effectspark.sources.store import Workspace

BITS = 2  # a round merges 2 ** BITS runs into one
KEY = ("digest", "second", "length")


def exact_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per input row.

    Texts are equal if they are identical without the characters of SPACE. The row
    with the most code points stays, of those the one with the smallest doc_id.
    NULL texts count as empty. A NULL doc_id loses against any other, and if all
    rows of a group have one, ``keep_id`` is NULL. Rows that repeat the staying
    doc_id and length all count as the one that stays. Other columns are ignored;
    an empty table gives no rows.
    """
    runs = ws.save(_sorted_runs(docs), "digest-runs").df
    last = runs.agg(F.max("run")).first()[0] or 0
    merged = runs.groupBy("run", *KEY).agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("rows"))
    for _ in range(-(-last.bit_length() // BITS)):
        merged = (
            merged.groupBy(F.shiftright("run", BITS).alias("run"), *KEY)
            .agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
        )
    winners = merged.select(*KEY, "best", "rows")
    stays = _rank() == F.col("best")
    return runs.join(winners, list(KEY)).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _sorted_runs(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    bare = texts.select(
        "doc_id",
        F.length("text").alias("n_chars"),
        F.regexp_replace("text", SPACE, "").cast("binary").alias("bare"),
    )
    return bare.select(
        F.spark_partition_id().alias("run"),
        "doc_id",
        "n_chars",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.xxhash64("bare").alias("second"),
        F.octet_length("bare").alias("length"),
    )


def _rank() -> Column:
    """Least for the row that stays."""
    return F.struct(
        (-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id")
    )
