"""Products laid out for listings: folders by a hash of the category, and in each files in order of category and brand.

A listing of a category reads one folder, and of its files the row groups whose range of brands holds the brand asked for. The
number of folders is fixed, however many categories there are. A category or brand of a third of all rows is still several
files, since the id is last in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.listing import brands, products_by
from millrace.sources.products import COLUMNS, SCHEMA
from millrace.sources.store import Store

SHELVES, ROWS_PER_FILE = 64, 1_000_000


def _shelf(category: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(category), F.lit(shelves)).cast("int")


def lay_out(products: DataFrame, path: str, shelves: int = SHELVES, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes the products to a new folder. Null and empty categories are values like any other."""
    order = ["shelf", "category", "brand", "id"]
    placed = products.select(*COLUMNS, _shelf(F.col("category"), shelves).alias("shelf")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.partitionBy("shelf").option("maxRecordsPerFile", rows_per_file).parquet(path)
    Store(products.sparkSession, path).put_new("_shelves", str(shelves))


class Shelves:
    def __init__(self, spark: SparkSession, path: str):
        self.shelves = int(Store(spark, path).read("_shelves"))
        self.rows = spark.read.schema(f"{SCHEMA}, shelf int").parquet(path)

    def _of(self, category: str | None) -> DataFrame:
        found = self.rows if category is None else self.rows.where(F.col("shelf") == _shelf(F.lit(category), self.shelves))
        return found.drop("shelf")

    def products_by(self, category: str | None = None, brand: str | None = None) -> DataFrame:
        """As listing.products_by: a missing or empty parameter asks for nothing."""
        return products_by(self._of(category or None), category, brand)

    def brands(self, category: str | None = None) -> DataFrame:
        """As listing.brands: only a missing parameter means shoes."""
        return brands(self._of("shoes" if category is None else category), category)
