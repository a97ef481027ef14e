"""Which notes are hidden: older versions of replaceable and addressable notes, and deleted notes.

A deletion (kind 5) is never hidden itself.  It hides notes of its own author
only: those whose id an ``e`` tag names, whenever they come, and versions of the
address that an ``a`` tag names up to the time of the deletion.

The rules are kept as two small tables, each a grouping that can be merged with
another of its kind, so that a store can keep them up as notes come in:

* addresses: address, winner (the newest version, of equals the lowest id),
  deleted_at;
* deletions: id, by (authors of the deletions that name it).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import tags as tag
from tidelog.schema import DELETION

SEARCH_ONLY, ALWAYS, NONE = "search_only", "always", "none"
MODES = (SEARCH_ONLY, ALWAYS, NONE)


def own_address() -> Column:
    return tag.address(F.col("kind"), F.col("pubkey"), tag.first_d(F.col("tags")))


def _version() -> Column:
    """Sorts the version that wins first."""
    return F.struct((-F.col("created_at")).alias("age"), F.col("id").alias("id"))


@dataclass
class Visibility:
    addresses: DataFrame
    deletions: DataFrame

    @classmethod
    def of(cls, notes: DataFrame) -> Visibility:
        """From all notes.  Reads ids, keys, times, kinds and tags of replaceable notes and deletions only."""
        versions = notes.select(own_address().alias("address"), _version().alias("winner"), F.lit(None).cast("long").alias("deleted_at")).where("address is not null")
        said = notes.where(F.col("kind") == DELETION)
        named = said.select("pubkey", "created_at", F.explode(tag.values(F.col("tags"), "a")).alias("value"))
        gone = named.select(tag.named_address(F.col("value"), F.col("pubkey")).alias("address"), F.lit(None).cast(versions.schema["winner"].dataType).alias("winner"), F.col("created_at").alias("deleted_at")).where("address is not null")
        ids = said.select("pubkey", F.explode(tag.values(F.col("tags"), "e")).alias("id")).where(F.col("id").rlike(tag.HEX64))
        return cls(merged_addresses(versions.unionByName(gone)), ids.groupBy(F.lower("id").alias("id")).agg(F.collect_set("pubkey").alias("by")))

    def merge(self, other: Visibility) -> Visibility:
        """Both together; what one hides stays hidden."""
        by = self.deletions.unionByName(other.deletions).select("id", F.explode("by").alias("key"))
        return Visibility(merged_addresses(self.addresses.unionByName(other.addresses)), by.groupBy("id").agg(F.collect_set("key").alias("by")))

    def flagged(self, notes: DataFrame, to: str = "visible") -> DataFrame:
        """``notes`` with a column that tells whether the note is visible.

        Notes without an address join under a key of their own, their id, so they
        don't meet in one task.
        """
        first = notes.withColumn("__address", F.coalesce(own_address(), F.col("id")))
        first = first.join(self.addresses.withColumnRenamed("address", "__address"), "__address", "left")
        own = _version()
        old = F.coalesce(own > F.col("winner"), F.lit(False))
        gone = F.coalesce(F.col("created_at") <= F.col("deleted_at"), F.lit(False))
        first = first.withColumn("__hidden", old | gone).drop("__address", "winner", "deleted_at")
        both = first.join(self.deletions.select("id", F.col("by").alias("__by")), "id", "left")
        named = F.coalesce(F.array_contains("__by", F.col("pubkey")), F.lit(False))
        return both.withColumn(to, (F.col("kind") == DELETION) | ~(F.col("__hidden") | named)).select(*notes.columns, to)

    def visible(self, notes: DataFrame) -> DataFrame:
        flag = "__visible"
        return self.flagged(notes, flag).where(flag).drop(flag)


def merged_addresses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("address").agg(F.min("winner").alias("winner"), F.max("deleted_at").alias("deleted_at"))


def replace_winners(notes: DataFrame) -> DataFrame:
    """(address, id, created_at) of the winning version of every address."""
    table = Visibility.of(notes).addresses.where("winner is not null")
    return table.select("address", F.col("winner.id").alias("id"), (-F.col("winner.age")).alias("created_at"))
