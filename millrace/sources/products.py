"""The products table: its schema, configuration, reading, refresh, insertion, and an adapter from the part tables."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable, Hashable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import new_path
from millrace.sources.store import Store
from millrace.sources.versions import Versioned

SCHEMA = "id string, title string, brand string, price string, url string, category string, image_url string, created_at timestamp_ntz, owner_id string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def checked(df: DataFrame) -> DataFrame:
    """df with the columns of SCHEMA in order; an error names what is missing or of another type."""
    wanted = dict(c.split() for c in SCHEMA.split(", "))
    odd = {c: dict(df.dtypes).get(c) for c, kind in wanted.items() if dict(df.dtypes).get(c) != kind}
    if odd:
        raise ValueError(f"products has {odd}, wanted {({c: wanted[c] for c in odd})}")
    return df.select(*COLUMNS)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark.read.parquet(path))


def append(rows: DataFrame, path: str) -> DataFrame:
    """Adds rows to the table at path; returns the rows as added."""
    rows = checked(rows)
    rows.write.mode("append").parquet(path)
    return rows


def single(df: DataFrame) -> DataFrame:
    """df, if it has exactly one row."""
    if (n := len(df.take(2))) != 1:
        raise ValueError(f"exactly one row expected, {'none' if not n else 'several'} found")
    return df


def products_path(environment: Mapping[str, str] = os.environ) -> str:
    """Where the table is, from MILLRACE_PRODUCTS; an error at once where that is unset."""
    if not (path := environment.get("MILLRACE_PRODUCTS")):
        raise RuntimeError("MILLRACE_PRODUCTS is not set: it has to name the products table")
    return path


def said(error: BaseException) -> str:
    """What an error says, or a stock text where it says nothing."""
    return str(error) or "Something went wrong."


class Products:
    """The table as last read well, in `rows`: read once at the start, then at each refresh.

    A refresh that fails keeps the rows before it and says why in `error`; before the first good one there are no rows.
    Of a Versioned table a refresh copies nothing: the rows are the files of its newest version, which stay pinned. Other
    writers may take away the files of a plain folder at any time, so of that the rows are a copy in the shared folder. A good
    refresh frees what the one before held, so rows and lists of before can't be read any more.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.error = spark, path or products_path(), None
        self.versions: Versioned | None = None
        self._base = self.rows = spark.createDataFrame([], SCHEMA)
        self._free: Callable[[], None] = lambda: None
        self._made: dict[object, tuple[DataFrame, str]] = {}
        self._added: list[tuple] = []
        self.refresh()

    def refresh(self) -> DataFrame:
        self.error = None
        try:
            if self.versions is None and Versioned.exists(self.spark, self.path):
                self.versions = Versioned(self.spark, self.path, SCHEMA, "id")
            rows, free = self._pinned(self.versions) if self.versions else self._copied()
            rows.createOrReplaceTempView("products")
            held, self._free = self._free, free
            held()
            self._forget()
            self._base = self.rows = rows
            self._added = []
        except Exception as e:  # whatever the store says
            self.error = said(e)
        return self.rows

    def _pinned(self, versions: Versioned) -> tuple[DataFrame, Callable[[], None]]:
        if not Versioned.exists(self.spark, self.path):
            raise FileNotFoundError(f"{self.path} has no version")
        held = versions.pin()

        def free() -> None:
            if versions.version().number != held.number:
                versions.release(held)
                versions.free()

        return versions.rows(held), free

    def _copied(self) -> tuple[DataFrame, Callable[[], None]]:
        path = new_path(self.spark, "products")
        read_products(self.spark, self.path).write.parquet(path)
        return self.spark.read.schema(SCHEMA).parquet(path), lambda: Store(self.spark, path).delete("")

    def _forget(self) -> None:
        for _, path in self._made.values():
            Store(self.spark, path).delete("")
        self._made = {}

    def add(self, product: Mapping[str, str | None], now: dt.datetime | None = None) -> DataFrame:
        """Stores one product and gives its row back, with the id and time it got; the rows here start with it.

        An image that is not given is null; id, time and owner are not the caller's to set.
        """
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        given = {c: product.get(c) for c in ("title", "brand", "price", "url", "category", "image_url")}
        row = given | {"id": uuid.uuid4().hex, "created_at": now, "owner_id": None}
        values = tuple(row[c] for c in COLUMNS)
        new = single(self.spark.createDataFrame([values], SCHEMA))
        if self.versions:
            self.versions.append(new)
        else:
            append(new, self.path)
        # One union, however many rows are added before the next refresh.
        self._added.insert(0, values)
        self.rows = self.spark.createDataFrame(self._added, SCHEMA).unionByName(self._base)
        self._forget()
        return new

    def made(self, key: Hashable, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """build(rows), computed once for these rows; `key` names it with its parameters. A refresh forgets it."""
        if key not in self._made:
            path, rows = new_path(self.spark, "made"), build(self.rows)
            rows.write.parquet(path)
            self._made[key] = self.spark.read.schema(rows.schema).parquet(path), path
        return self._made[key][0]


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products view over part, pages and lineitem: one row per part."""
    part, pages, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "pages", "lineitem"))
    sold = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("owner"), F.max("l_shipdate").alias("shipped"))
    shown = pages.select(F.col("page_id").alias("p_partkey"), "url")
    return part.join(sold, "p_partkey", "left").join(shown, "p_partkey", "left").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("string").alias("price"),
        "url",
        F.col("p_type").alias("category"),
        F.lit(None).cast("string").alias("image_url"),
        F.when(F.col("p_size") % 17 != 0, F.col("shipped")).alias("created_at"),
        F.when(F.col("p_size") % 10 != 0, F.col("owner").cast("string")).alias("owner_id"),
    )
