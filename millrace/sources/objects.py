"""Images as objects: read from files, stored under a name that can be taken once, served by address.

The objects are rows (path, mime, content) of a Versioned table whose key is the path. So a name is taken or free whatever else
is written at the same time, a task that is run again stores nothing twice, and bytes go from executor to executor, never to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import file_ext, mime_type
from millrace.sources.shared import table
from millrace.sources.versions import Versioned

#: Bytes of the largest image that is read.
MOST_BYTES = 64 << 20


def read_images(spark: SparkSession, *paths: str, most: int = MOST_BYTES) -> DataFrame:
    """(image_uri, content) of the files in folders or of a pattern. Files over `most` bytes are left out without being opened.

    image_uri is the file's whole address. An image is one row, so a task holds a few at a time.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.where(F.col("length") <= most).select(F.col("path").alias("image_uri"), "content")


class Objects:
    def __init__(self, spark: SparkSession, path: str):
        self.held = Versioned(spark, path, "path string, mime string, content binary", "path")

    def put(self, objects: DataFrame) -> DataFrame:
        """Stores objects (path, content, and `source`, which names each), in one commit, under names that are free; gives the
        others as (source, path, reject_reason). None is overwritten.

        Of several for one name the one of the smallest source wins and the others are `taken`, as are those whose name
        was stored before; without a name an object is `missing` one. The type goes by the name's extension.
        """
        first = objects.groupBy("path").agg(F.min("source").alias("source"))
        first = table(first)  # names alone: the bytes are read when they are written
        wins = objects.join(first.where("path is not null"), ["path", "source"], "left_semi").select("path", mime_type(file_ext(F.col("path"))).alias("mime"), "content")
        stored = table(self.held.append(wins).select(F.col("key").alias("path"), F.lit(True).alias("stored")))
        asked = objects.select("source", "path").join(first.select(F.col("path"), F.col("source").alias("first")), "path", "left").join(stored, "path", "left")
        lost = F.when(F.col("path").isNull(), "missing").when(F.col("stored") | (F.col("source") != F.col("first")), "taken")
        return table(asked.select("source", "path", lost.alias("reject_reason")).where("reject_reason is not null"))

    def rows(self) -> DataFrame:
        return self.held.rows()

    def get(self, path: str) -> DataFrame:
        """The object of a name, or no row; the name reaches the scan."""
        return self.rows().where(F.col("path") == path)
