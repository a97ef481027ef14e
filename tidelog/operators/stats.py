"""Aggregates over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.visibility import Visibility
from tidelog.schema import payload, unix_day


def without_content(notes: DataFrame, size: Column) -> DataFrame:
    """What visibility needs of notes, with ``size`` as bytes: no text travels to be measured."""
    days = ["unix_day"] if "unix_day" in notes.columns else []
    return notes.select("id", "pubkey", "created_at", "kind", "tags", *days, size.cast("long").alias("bytes"))


def database_stats(notes: DataFrame, rules: Visibility | None = None) -> DataFrame:
    """One row: count and bytes (of the JSON payloads) of the visible notes."""
    sized = without_content(notes, F.octet_length(payload()))
    seen = (rules or Visibility.of(notes)).visible(sized).dropDuplicates(["id"])
    return seen.agg(F.count("*").alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def day_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(unix_day(F.col("created_at")).alias("unix_day")).agg(F.count("*").alias("count"), F.countDistinct("id").alias("ids"))


def day_items(notes: DataFrame, day: int) -> DataFrame:
    """(created_at, id) of all notes of a UTC day, hidden ones too, oldest first, each id once."""
    of_day = notes.where(F.col("created_at").between(day * 86400, day * 86400 + 86399))
    if "unix_day" in notes.columns:
        of_day = of_day.where(F.col("unix_day") == day)
    return of_day.select("created_at", "id").dropDuplicates(["id"]).orderBy("created_at", "id")


def fingerprint(notes: DataFrame) -> DataFrame:
    """One row: count, bytes and a hash of the notes, each id once, that doesn't depend on their order: two stores that hold
    the same have the same."""
    number = F.conv(F.substring(F.md5(F.col("p").cast("binary")), 1, 15), 16, 10).cast("long")
    hashed = notes.select("id", payload().alias("p")).select("id", F.octet_length("p").alias("bytes"), number.alias("hash"))
    one = hashed.dropDuplicates(["id"])  # slim rows: the hash is made before the exchange
    return one.agg(F.count("*").alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.bit_xor("hash"), F.lit(0)).cast("long").alias("hash"))
