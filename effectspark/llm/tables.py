"""The tables the operators read, and what their Python tasks share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectspark.session import configure
from effectspark.sources.store import Workspace

# Rows handed to a Python task at once. A task holds one batch of texts, never its whole partition.
BATCH_ROWS = 256
SPACE = r"[\x20\x09-\x0D]+"


def start(spark: SparkSession, batch_rows: int = BATCH_ROWS) -> Workspace:
    """Runtime settings of the operators, and a folder for their tables.

    Python workers look for this package where the driver found it; on a cluster that
    does not share that folder, install it or pass it with ``--py-files``.
    """
    configure(spark)
    environment = spark.sparkContext.environment
    paths = [environment.get("PYTHONPATH", ""), str(Path(__file__).resolve().parents[2])]
    environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(p for part in paths for p in part.split(os.pathsep) if p))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return Workspace(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One value per (doc_id, text), NULLs included; rows equal in both are one document."""
    where = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    return F.md5(F.concat(where, F.lit(":"), F.col(text).isNull().cast("string"), text_or_empty(text)).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
