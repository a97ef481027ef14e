"""The one row type, and the classes of kinds that have rules of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.LongType()),
        T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)
COLUMNS = NOTE.names

# fixed values
PROFILE, DELETION, LONG_FORM = 0, 5, 30023
REPLACEABLE = (0, 3, 41)
REPLACEABLE_RANGE = (10000, 19999)
ADDRESSABLE_RANGE = (30000, 39999)
DAY = 86400
MOST_ADDRESS_BYTES = 255
LARGEST_LONG = (1 << 63) - 1


def is_replaceable(kind: Column) -> Column:
    return kind.isin(*REPLACEABLE) | kind.between(*REPLACEABLE_RANGE)


def is_addressable(kind: Column) -> Column:
    return kind.between(*ADDRESSABLE_RANGE)


def unix_day(created_at: Column) -> Column:
    """The UTC day; seconds before 1970 don't occur."""
    return F.floor(created_at / F.lit(DAY)).cast("long")


def payload() -> Column:
    """A note as one JSON object."""
    return F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").asc()]
