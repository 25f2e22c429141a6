"""A table as a list of files: versions, pins, changes file by file, and keys that can't repeat.

Under the table's folder:

    data/<commit>/*.parquet    rows; a file never changes once a version names it
    keys/<commit>/*.parquet    a Bloom filter of the keys of each of those files
    versions/<number>          the files that are the table, and the folders of their filters, as JSON
    pins/<number>-<reader>     a reader that holds a version

A commit writes its files and then the next version, whose name can be taken once only; who comes second looks at what came
between and tries again. So readers see all of a commit or nothing, and a reader's list of files is its snapshot: no row
is copied for it. Versions that are neither the newest nor pinned are freed, and with them the files that only they name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import table
from millrace.sources.store import Store

#: Bits in a block of a filter, as bitmap_construct_agg makes it, for a key; and how many of them a key sets.
BLOCK_BITS, BITS_PER_KEY, BITS_SET = 1 << 15, 24, 12

#: A pin older than this, in seconds, is of a reader that died.
LEASE = 7 * 86_400.0

#: How often a commit is tried again.
TRIES = 20


class Conflict(RuntimeError):
    """Another commit changed the same files."""


@dataclass(frozen=True)
class Version:
    number: int
    files: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()


def _bits(key: Column) -> Column:
    """Places of a key within its block."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(BITS_SET)])


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def key_filters(keys: DataFrame) -> DataFrame:
    """Blocked Bloom filters (file, blocks, block, bitmap) of keys (file, key); blocks is a power of two."""
    counts = keys.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.ceil(F.log2(F.greatest(F.col("n") * BITS_PER_KEY / BLOCK_BITS, F.lit(1.0)))).cast("int")
    sized = keys.join(counts.select("file", F.expr("1L").alias("one"), wanted.alias("power")), "file")
    sized = sized.withColumn("blocks", F.expr("shiftleft(one, power)"))
    placed = sized.select("file", "blocks", F.pmod(F.xxhash64("key"), "blocks").alias("block"), F.explode(_bits(F.col("key"))).alias("bit"))
    return placed.groupBy("file", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def may_hold(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """(file, key) of keys (key) that a file's filter has; few that it doesn't hold, and all that it does."""
    sizes = [r["blocks"] for r in filters.select("blocks").distinct().collect()]  # powers of two, so some 30
    if not sizes:
        return keys.select(F.lit("").alias("file"), "key").where("false")
    probes = keys.select("key", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("blocks"))
    probes = probes.withColumns({"block": F.pmod(F.xxhash64("key"), "blocks"), "bits": _bits(F.col("key"))})
    met = filters.join(probes, ["blocks", "block"])
    return met.where(F.forall("bits", lambda b: _is_set(F.col("bitmap"), b))).select("file", "key")


class Versioned:
    """The table at `path`, of `schema`; `key` names a column of strings that may not repeat or be null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None):
        self.spark, self.path, self.schema, self.key, self.store = spark, path, schema, key, Store(spark, path)
        self._pins: dict[int, str] = {}

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return bool(Store(spark, path).names("versions"))

    # Reading

    def numbers(self) -> list[int]:
        return [int(x) for x in self.store.names("versions")]

    def version(self, number: int | None = None) -> Version:
        """The newest, or that of a number; before the first commit there is version 0, of no files."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return Version(0)
        found = json.loads(self.store.read(f"versions/{number:020d}"))
        return Version(number, tuple(found["files"]), tuple(found["filters"]))

    def rows(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, by default the newest. Its files are the snapshot, so pin it to keep them."""
        return self._read((version or self.version()).files)

    def _read(self, files: tuple[str, ...] | list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def pin(self) -> Version:
        """The newest version, which stays readable until `release`, however many commits follow."""
        for _ in range(TRIES):
            found = self.version()
            if not found.number or found.number in self._pins:
                return found
            name = f"pins/{found.number:020d}-{uuid.uuid4().hex}"
            self.store.put_new(name, "")
            self.store.delete(name, when_driver_ends=True)
            if self.store.exists(f"versions/{found.number:020d}"):  # else it was freed meanwhile
                self._pins[found.number] = name
                return found
            self.store.delete(name)
        raise Conflict(f"no version of {self.path} could be pinned")

    def release(self, version: Version) -> None:
        if name := self._pins.pop(version.number, None):
            self.store.delete(name)

    def free(self, lease: float = LEASE) -> list[int]:
        """Frees the versions before the newest that no reader holds, and the files that only they name; their numbers."""
        numbers = self.numbers()
        pinned = {int(x.split("-")[0]) for x in self.store.names("pins") if self.store.age_seconds(f"pins/{x}") < lease}
        gone = [n for n in numbers[:-1] if n not in pinned]
        if not gone:
            return []
        old, kept = [self.version(n) for n in gone], [self.version(n) for n in numbers if n not in gone]
        for n in gone:
            self.store.delete(f"versions/{n:020d}")
        for part in ("files", "filters"):
            held = {x for v in kept for x in getattr(v, part)}
            for x in {x for v in old for x in getattr(v, part)} - held:
                self.store.delete(x)
        return gone

    # Commits

    def _write(self, rows: DataFrame) -> tuple[list[str], list[str]]:
        """Files of rows, and the folder of their filters."""
        commit = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{commit}")
        files = [f"data/{commit}/{x}" for x in self.store.names(f"data/{commit}") if x.endswith(".parquet")]
        if not self.key or not files:
            return files, []
        keys = self._keys(files).where("key is not null")
        key_filters(keys).write.parquet(f"{self.path}/keys/{commit}")
        return files, [f"keys/{commit}"]

    def _keys(self, files: list[str]) -> DataFrame:
        """(file, key) of all rows of some files, a file by its last three names."""
        return self._read(files).select(F.substring_index(F.col("_metadata.file_path"), "/", -3).alias("file"), F.col(self.key).alias("key"))

    def _commit(self, base: Version, files: tuple[str, ...], filters: tuple[str, ...]) -> Version | None:
        number = base.number + 1
        if self.store.put_new(f"versions/{number:020d}", json.dumps({"files": files, "filters": filters})):
            return Version(number, files, filters)
        return None

    def filters(self, version: Version, of: tuple[str, ...] | None = None) -> DataFrame:
        """The filters of a version's files; `of`: of some of its folders of filters only."""
        folders = version.filters if of is None else of
        if not folders:
            return self.spark.createDataFrame([], "file string, blocks long, block long, bitmap binary")
        found = self.spark.read.schema("file string, blocks long, block long, bitmap binary").parquet(*[f"{self.path}/{f}" for f in folders])
        here = self.spark.createDataFrame([(f,) for f in version.files], "file string")
        return found.join(here, "file", "left_semi")  # of files that a rewrite took away, filters may be left

    def holding(self, keys: DataFrame, version: Version | None = None, of: tuple[str, ...] | None = None) -> DataFrame:
        """(file, key) of keys (key) for the files that hold them. Only files whose filter has a key are opened, and of those
        the key column alone is read; no stored row is shuffled unless the keys themselves are many."""
        version = version or self.version()
        likely = table(may_hold(self.filters(version, of), keys.distinct()))
        files = [r["file"] for r in likely.select("file").distinct().collect()]  # some of the version's list
        if not files:
            return likely
        return self._keys(files).join(likely.select("key").distinct(), "key", "left_semi").select("file", "key").distinct()

    def refused(self, rows: DataFrame, version: Version | None = None, of: tuple[str, ...] | None = None) -> DataFrame:
        """(key, reject_reason) of rows that can't be stored: `missing` (null), `twice` (several of rows) or `stored`."""
        counts = table(rows.groupBy(F.col(self.key).alias("key")).agg(F.count(F.lit(1)).alias("n")))
        known = self.holding(counts.where("key is not null").select("key"), version, of).select("key").distinct().withColumn("known", F.lit(True))
        reason = F.when(F.col("key").isNull(), "missing").when(F.col("known"), "stored").when(F.col("n") > 1, "twice")
        return counts.join(known, "key", "left").select("key", reason.alias("reject_reason")).where("reject_reason is not null")

    def append(self, rows: DataFrame) -> DataFrame:
        """Stores the rows whose keys are new, in one commit; gives back the others' keys with the reason of their refusal.

        Of rows that share a key none is stored, since nothing says which is meant. Without a key all are stored.
        """
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns)
        files, filters = self._write(rows)
        base, bad = self.version(), self.spark.createDataFrame([], "key string, reject_reason string")
        unseen = base.filters
        for _ in range(TRIES):
            if self.key and not (worse := table(self.refused(self._read(files), base, unseen))).isEmpty():
                keys = worse.where("key is not null").select(F.col("key").alias(self.key))
                kept = self._read(files).where(F.col(self.key).isNotNull()).join(keys, self.key, "left_anti")
                old = [*files, *filters]
                files, filters = self._write(kept)
                for x in old:
                    self.store.delete(x)
                bad = bad.unionByName(worse)
            if self._commit(base, (*base.files, *files), (*base.filters, *filters)):
                return bad
            # Someone else was first: what they added may hold these keys.
            now = self.version()
            unseen, base = tuple(x for x in now.filters if x not in base.filters), now
        raise Conflict(f"{self.path} changed {TRIES} times meanwhile")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> list[str]:
        """Replaces the files that hold some of keys (key) by what `change` makes of their rows, and adds the rows `more`, in
        one commit; gives the files replaced.

        All other files stay as they are. change has to leave the keys of rows that stay alone, and more to bring new ones. If
        another commit replaced one of these files meanwhile, they are looked for anew.
        """
        keys = table(keys.where("key is not null").distinct())
        for _ in range(TRIES):
            base = self.version()
            files = sorted(r["file"] for r in self.holding(keys, base).select("file").distinct().collect())
            rows = change(self._read(files)).coalesce(len(files)) if files else None
            if more is not None:
                rows = more if rows is None else rows.unionByName(more)
            if rows is None:
                return []
            made, filters = self._write(rows)
            while set(files) <= set(base.files):
                kept = tuple(f for f in base.files if f not in files)
                # Filters of commits none of whose files are left go with them.
                commits = {f.split("/")[1] for f in kept}
                old = tuple(f for f in base.filters if f.split("/")[1] in commits)
                if self._commit(base, (*kept, *made), (*old, *filters)):
                    return files
                base = self.version()
        raise Conflict(f"{self.path} changed {TRIES} times meanwhile")
