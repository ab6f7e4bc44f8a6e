"""A rating log derived from the star-schema tables.

Orders' customers rate the parts of their order lines. A rating is a planted
item effect plus a planted user effect plus noise from the ordered quantity,
on the half-star scale; all arithmetic is on exact binary fractions. Dates are
spread over the day, and every 97th item has no year in its title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectspark.functions import columns as C
from effectspark.operators import features, split
from effectspark.sources.delimited import fact_join
from effectspark.sources.store import Stored, Workspace

ROW_KEY = ("user_id", "item_id", "epoch_s")

# The rating rule, and the rows whose item or user is held out whole.
RATING_RULE = """
    least(5e0, greatest(5e-1, floor(2e0 * (3e0
      + ((l_partkey * 37) % 11 - 5) / 8e0
      + ((o_custkey * 53) % 7 - 3) / 8e0
      + (ceil(l_quantity / 5e0) / 2e0 - 2.75e0) / 2e0) + 5e-1) / 2e0))
"""
EPOCH_RULE = """
    timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)
      + (l_orderkey * 7919 + l_linenumber * 104729) % 86400
"""
COLD_RULE = "item_id % 97 = 3 OR user_id % 89 = 5"


# The tables that the rating log and its items come from.
SOURCES = ("lineitem", "orders", "part")

# The columns read from each table; a stated schema saves a job per read.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "part": "p_partkey bigint, p_name string, p_type string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.expr(RATING_RULE).alias("rating"),
        F.expr(EPOCH_RULE).alias("epoch_s"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey")
    dated = F.concat(name, F.lit(" ("), (F.lit(1930) + key % 70).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        F.when(key % 97 == 0, name).otherwise(dated).alias("title"),
        F.concat_ws("|", "p_type", F.replace(name, F.lit(" "), F.lit("|"))).alias("genres"),
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_all(fact_join(ratings(spark, sf_dir), items(spark, sf_dir)))


def with_holdout(df: DataFrame) -> DataFrame:
    """Row hash ``h`` and the first, unprotected holdout flag ``temp``."""
    hashed = df.withColumn("h", C.row_hash(*ROW_KEY))
    return hashed.withColumn("temp", split.holdout(F.col("h")) | F.expr(COLD_RULE))


def split_ratings(spark: SparkSession, sf_dir: str, ws: Workspace) -> DataFrame:
    """The log with ``h``, ``temp`` and ``is_val``; no item columns yet."""
    return split.protected(with_holdout(ratings(spark, sf_dir)), ws)


def split_features(spark: SparkSession, sf_dir: str, ws: Workspace) -> DataFrame:
    return features.add_all(fact_join(split_ratings(spark, sf_dir, ws), items(spark, sf_dir)))


def model_frame(spark: SparkSession, sf_dir: str, ws: Workspace, *extra: str) -> Stored:
    """What a fit reads, written once: a fit passes over it several times."""
    keep = [
        *ROW_KEY, "rating", "release_year", "age_at_review", "genres", *features.CALENDAR, *extra, "is_val",
    ]
    frame = split_features(spark, sf_dir, ws).select(*keep)
    return ws.save(frame, "frame", partition_by=["is_val"])
