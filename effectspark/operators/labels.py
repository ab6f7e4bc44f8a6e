"""Single labels inside a pipe-delimited label list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: delimiter of the label list, as a pattern.
LABEL_DELIMITER = r"[|]"


def label_array(labels: str = "genres") -> Column:
    return F.split(F.col(labels), LABEL_DELIMITER)


def explode_labels(df: DataFrame, labels: str = "genres", name: str = "label") -> DataFrame:
    """One row per label; a missing list stays one row with a NULL label."""
    return df.withColumn(name, F.explode_outer(label_array(labels))).drop(labels)


def profile_label(lists: DataFrame, labels: str = "genres", value: str = "rating") -> DataFrame:
    """Mean and row count per single label, from sums ``s`` and counts ``n`` per label list.

    Only distinct lists are exploded.
    """
    return (
        explode_labels(lists, labels)
        .groupBy("label")
        .agg((F.sum("s") / F.sum("n")).alias(f"mean_{value}"), F.sum("n").alias("n"))
    )


def contains_counts(lists: DataFrame, words: Sequence[str], labels: str = "genres") -> DataFrame:
    """Rows whose label text contains each word, from counts ``n`` per label list; all words in one pass."""
    hits = [
        F.coalesce(F.sum(F.when(F.col(labels).contains(w), F.col("n"))), F.lit(0)).alias(f"hits_{i}")
        for i, w in enumerate(words)
    ]
    rows = [F.struct(F.lit(w).alias("word"), F.col(f"hits_{i}").alias("n")) for i, w in enumerate(words)]
    return lists.agg(*hits).select(F.inline(F.array(*rows)))


def indicators(df: DataFrame, vocabulary: Sequence[str], labels: str = "genres") -> DataFrame:
    """A yes/no column per label of a given vocabulary."""
    has = {f"has_{w}": F.array_contains(label_array(labels), w) for w in vocabulary}
    return df.withColumns(has)
