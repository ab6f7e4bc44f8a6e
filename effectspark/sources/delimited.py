"""Readers for the two delimited text inputs, and their join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiter and field order of the input files.
DELIMITER = "::"
RATING_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("epoch_s", T.LongType()),
    ]
)
ITEM_COLUMNS = ("item_id", "title", "genres")


def read_ratings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rating log without header: user, item, rating, epoch seconds.

    Fields that cannot be read are NULL, and absent ones too; :func:`bad_lines` shows
    such lines. ``strict`` makes them an error when the rows are read.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return spark.read.csv(path, sep=DELIMITER, schema=RATING_SCHEMA, header=False, quote="", mode=mode)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a rating log that do not have four readable fields; an empty field is a NULL."""
    return spark.read.text(path).filter(~_readable()).select(F.col("value").alias("line"))


def rating_quality(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a rating log, and how many of them could not be read in full."""
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~_readable()).alias("bad_lines")
    )


def _readable() -> Column:
    parts = F.split("value", DELIMITER, -1)
    good = F.size(parts) == len(RATING_SCHEMA)
    for i, field in enumerate(RATING_SCHEMA):
        text = F.get(parts, F.lit(i))
        good = good & ((text == "") | text.try_cast(field.dataType).isNotNull())
    return F.coalesce(good, F.lit(False))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item file without header: id, title, label list."""
    return parse_item_lines(spark.read.text(path))


def parse_item_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Split into exactly three fields.

    What follows the second delimiter belongs to the third field; absent fields
    are empty strings. A CSV reader would drop the extra text.
    """
    parts = F.split(F.col(column), DELIMITER, len(ITEM_COLUMNS))
    fields = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(len(ITEM_COLUMNS))]
    item_id, title, genres = fields
    return lines.select(item_id.try_cast("bigint").alias("item_id"), title.alias("title"), genres.alias("genres"))


def fact_join(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Every rating with its item's title and labels; unknown items give NULLs.

    The item file's size is known to the planner, which broadcasts it below the
    session's threshold and lets AQE split skewed items above it.
    """
    side = items.withColumnRenamed("item_id", "__item")
    return ratings.join(side, F.col("item_id").eqNullSafe(F.col("__item")), "left").drop("__item")


def write_lines(df: DataFrame, path: str) -> str:
    """Write a frame as delimited lines without header.

    NULL becomes an empty field. A text that a reader would cut elsewhere is an error:
    one with a line break, or, before the last field, one with the delimiter or with a
    colon at its end.
    """
    fields = [_field(df, name, last=name == df.columns[-1]) for name in df.columns]
    df.select(F.concat_ws(DELIMITER, *fields).alias("value")).write.text(path)
    return path


def _field(df: DataFrame, name: str, last: bool) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    if not isinstance(df.schema[name].dataType, T.StringType):
        return text
    bad = text.rlike(r"[\r\n]") if last else text.rlike(rf"[\r\n]|{DELIMITER}|:$")
    problem = F.concat(F.lit(f"column {name} cannot be written as a field: "), text)
    return F.when(bad, F.raise_error(problem).cast("string")).otherwise(text)
