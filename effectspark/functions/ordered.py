"""Values as 64-bit integers in the same order."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_bits(value: Column, kind: T.DataType) -> Column:
    """A bigint that grows with the value; NULL stays NULL.

    Doubles are ordered as Spark orders them: -0.0 equals 0.0 and NaN is the greatest.
    """
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value.cast(T.DecimalType(38, kind.scale)) * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        plain = F.when(F.isnan(value), F.lit(float("nan"))).otherwise(value.cast("double") + F.lit(0.0))
        bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint")
        # bits of negative numbers grow with their size
        return F.when(value.isNull(), F.lit(None).cast("bigint")).when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    raise TypeError(f"values of type {kind.simpleString()} have no 64-bit order")


def from_ordered_bits(key: int, kind: T.DataType) -> Column:
    """The value that :func:`ordered_bits` gives this integer."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(key).cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.lit(key).cast("bigint")).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (F.lit(key).cast("decimal(38,0)") / F.lit(10**kind.scale).cast("decimal(19,0)")).cast(kind)
    if isinstance(kind, T.FractionalType):
        bits = key if key >= 0 else key ^ ((1 << 63) - 1)
        return F.lit(struct.unpack(">d", struct.pack(">q", bits))[0]).cast(kind)
    return F.lit(key).cast("bigint").cast(kind)
