"""Listings and the feed kept up to date from what changes, not built anew.

A change is told by the rows before it and after it: an insert has none before, a patch has the row twice. Toggles change
likes. Each costs what the change touches: the files that hold its ids, and the values whose first row it took away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import likes, listing
from millrace.operators.writes import latest, updated
from millrace.sources.products import COLUMNS, SCHEMA
from millrace.sources.shared import table
from millrace.sources.versions import Versioned


def firsts_after(firsts: DataFrame, column: str, before: DataFrame, after: DataFrame, products: DataFrame) -> DataFrame:
    """listing.firsts of `products`, from those before a change.

    Values whose first row is among `before` are looked up in products again, by a semi-join with those values; of all
    others the first row is the lesser of the old one and the change's. A value without rows goes.
    """
    gone = listing.firsts(before, column).select(F.col(column).alias("_value"), F.col("seen").alias("was"))
    old = table(firsts.join(gone, F.equal_null(F.col(column), F.col("_value")), "left").select(column, "seen", "was"))
    # Of a value's rows in the change the first is the value's first, or none of them is.
    lost = old.where("was = seen").select(F.col(column).alias("_value"))
    again = [] if lost.isEmpty() else [listing.firsts(products.join(lost, F.equal_null(F.col(column), F.col("_value")), "left_semi"), column)]
    found = old.where("was is null or was <> seen").select(column, "seen")
    for more in (listing.firsts(after, column), *again):
        found = found.unionByName(more)
    return table(found.groupBy(column).agg(F.min("seen").alias("seen")))


class Likes:
    """The likes (id, liked_seq) in a Versioned table, toggled batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.held = Versioned(spark, path, "id string, liked_seq long", "id")

    def rows(self) -> DataFrame:
        return self.held.rows()

    def toggle(self, toggles: DataFrame) -> list[str]:
        """Takes toggles (seq, id), all of them later than those before; gives the files written again.

        An id toggled an odd number of times changes sides; a liked one that ends up liked has the last toggle's seq.
        """
        counted = table(likes.counted(toggles.where("id is not null")))
        known = table(self.held.holding(counted.select(F.col("id").alias("key"))).select(F.col("key").alias("id")).distinct())
        odd = F.col("n") % 2 == 1

        def change(rows: DataFrame) -> DataFrame:
            met = rows.join(counted.withColumnRenamed("liked_seq", "last"), "id", "left")
            return met.where(F.col("n").isNull() | ~odd).select("id", F.coalesce("last", "liked_seq").alias("liked_seq"))

        new = counted.where(odd).join(known, "id", "left_anti").select("id", "liked_seq")
        return self.held.rewrite(known.select(F.col("id").alias("key")), change, None if new.isEmpty() else new)


class Feed:
    """The feed's rows with their like, in a Versioned table whose files are its pages, and the likes beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.likes = Likes(spark, f"{path}/likes")
        self.held = Versioned(spark, f"{path}/pages", f"{SCHEMA}, liked boolean", "id")

    def build(self, products: DataFrame, toggles: DataFrame, pages: int = 16) -> None:
        """The first time. Pages are ranges of the base order, so rows that are shown together are stored together."""
        self.likes.toggle(toggles)
        rows = listing.marked(products.select(*COLUMNS), self.likes.rows())
        self.held.append(rows.repartitionByRange(pages, listing.age(F.col("created_at")), "id"))

    def toggle(self, toggles: DataFrame) -> list[str]:
        """Takes later toggles (seq, id); gives the pages written again, those of the ids that change sides."""
        ids = likes.counted(toggles.where("id is not null")).where("n % 2 = 1").select(F.col("id").alias("key"))
        ids = table(ids)
        self.likes.toggle(toggles)
        turned = ids.select(F.col("key").alias("id"), F.lit(True).alias("turned"))
        liked = F.when(F.col("turned"), ~F.col("liked")).otherwise(F.col("liked"))
        return self.held.rewrite(ids, lambda rows: rows.join(turned, "id", "left").select(*COLUMNS, liked.alias("liked")))

    def insert(self, products: DataFrame) -> DataFrame:
        """Adds products; gives the refused ids. An id may have been liked before there was a product of it."""
        return self.held.append(listing.marked(products.select(*COLUMNS), self.likes.rows()))

    def patch(self, patches: DataFrame) -> list[str]:
        def change(rows: DataFrame) -> DataFrame:
            return updated(rows, patches).join(rows.select("id", "liked"), "id")

        return self.held.rewrite(latest(patches).select(F.col("id").alias("key")), change)

    def cards(self) -> DataFrame:
        """As listing.feed has them."""
        return listing.cards(self.held.rows())
