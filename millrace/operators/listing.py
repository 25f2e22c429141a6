"""Order, feed, first-seen listings, filters and lookup over products.

The base order is newest first, unknown times before all, then by id. No row order is kept between operators: each
that needs the order sorts by `age` and id, and positions come from a range-partitioned sort, not from one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import category_label, link_label, present
from millrace.sources.shared import table


def age(time: Column) -> Column:
    """A long that sorts like the base order, null first, without regard to time zones."""
    seconds = F.hour(time) * 3600 + F.minute(time) * 60
    micros = (F.extract(F.lit("second"), time) * 1_000_000).cast("long")
    return -(F.unix_date(time.cast("date")).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + micros)


def positions(df: DataFrame, *by: Column, name: str = "pos") -> DataFrame:
    """df with its place, from 0, in the order `by` (which should have no ties).

    Tasks sort ranges of the rows; a range's first place comes from the counts of the ranges before it, so only
    counts, one a task, meet in one window.
    """
    rows = table(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    counts = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    firsts = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_first"))
    # One row a task of the sort, so small by nature.
    placed = rows.withColumn("_task", task).join(F.broadcast(firsts), "_task")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("_first") + inside).alias(name))


def marked(products: DataFrame, likes: DataFrame) -> DataFrame:
    """products with `liked`; likes (distinct id) of unknown products count for nothing."""
    return products.join(likes.select("id", F.lit(True).alias("liked")), "id", "left").withColumn("liked", F.coalesce("liked", F.lit(False)))


def feed(products: DataFrame, likes: DataFrame) -> DataFrame:
    """Cards with their place: liked ones first, each class in base order."""
    return cards(marked(products, likes))


def cards(rows: DataFrame) -> DataFrame:
    """The feed of marked rows."""
    order = F.col("liked").desc(), age(F.col("created_at")).asc_nulls_first(), F.col("id")
    placed = positions(rows, *order)
    image = F.when(present(F.col("image_url")), F.col("image_url")).otherwise("IMG")
    return placed.select("pos", "id", image.alias("image"), "brand", F.upper("brand").alias("brand_label"), "title", F.when(present(F.col("price")), F.col("price")).alias("price"), "liked")


def first_seen(products: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column and their place, in order of the first row of each in base order."""
    return in_order_seen(firsts(products, column))


def firsts(products: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column and `seen`, the age and id of the first row of each."""
    return products.groupBy(column).agg(F.min(F.struct(age(F.col("created_at")).alias("age"), "id")).alias("seen"))


def in_order_seen(rows: DataFrame) -> DataFrame:
    return positions(rows, F.col("seen")).drop("seen")


def categories(products: DataFrame) -> DataFrame:
    return first_seen(products, "category").withColumn("label", F.upper("category"))


def brands(products: DataFrame, category: str | None = None) -> DataFrame:
    """Brands of a category; only a missing parameter means shoes, an empty one is itself."""
    return first_seen(products.where(F.col("category") == ("shoes" if category is None else category)), "brand")


def products_by(products: DataFrame, category: str | None = None, brand: str | None = None) -> DataFrame:
    """Rows of a category and brand; a missing or empty parameter asks for nothing. Strict equality, so a scan gets it."""
    asked = [F.col(c) == v for c, v in (("category", category), ("brand", brand)) if v]
    return products.where(reduce(Column.__and__, asked, F.lit(True))).select("id", "brand", "title", "price", "url")


# What an empty listing says.
NO_PRODUCTS = "No products yet for this brand in this category."
NO_BRANDS = "No brands yet for this category."


def if_empty(rows: DataFrame, message: str) -> DataFrame:
    """One row (message) if there are no rows, none if there are; reads no more than one row a task."""
    return rows.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(message).alias("message"))


def lookup(products: DataFrame, key) -> DataFrame:
    """The first row, in base order, whose id reads like the key; no rows if there is none."""
    return products.where(F.col("id").cast("string") == str(key)).orderBy(age(F.col("created_at")).asc_nulls_first(), "id").limit(1)


def detail(products: DataFrame, likes: DataFrame, key) -> DataFrame:
    return details(marked(lookup(products, key), likes))


# What the page and the edit form of an unknown product say.
NOT_FOUND = "Not found"
NOT_FOUND_TO_EDIT = "Product not found"


def not_found(products: DataFrame, keys: DataFrame, message: str = NOT_FOUND) -> DataFrame:
    """(key, message) of the keys (key) that no product's id reads like."""
    ids = products.select(F.col("id").cast("string").alias("key"))
    return keys.join(ids, "key", "left_anti").select("key", F.lit(message).alias("message"))


def details(rows: DataFrame) -> DataFrame:
    """What a product's page shows; rows are marked ones."""
    image = F.when(present(F.col("image_url")), F.col("image_url")).otherwise("No Image")
    return rows.select(
        "id",
        image.alias("image"),
        "brand",
        F.upper("brand").alias("brand_label"),
        "title",
        category_label(F.col("category")).alias("category"),
        F.when(present(F.col("price")), F.col("price")).alias("price"),
        link_label(F.col("url")).alias("link"),
        "liked",
    )


def edit_form(products: DataFrame) -> DataFrame:
    """The fields as an edit form starts with them."""
    text = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)
    return products.select("id", text("title"), text("brand"), F.when(present(F.col("price")), F.col("price")).otherwise("").alias("price"), text("category", "shoes"), text("url"))
