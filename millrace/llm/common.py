"""What several operators need: sampling, row ids, Arrow text access, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import table

#: Bytes of text that a numpy step handles at once (one longer document is a step of its own).
STEP_BYTES = 1 << 18

#: Bytes of an Arrow batch, of which the JVM and each Python worker hold several at a time; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20

#: The bytes that part words where words are runs of anything else.
SPACE = np.isin(np.arange(256), [*range(9, 14), 32])

#: Bits of a bitmap, as a power of two: 128 kB to 32 MB.
LEAST_BITS, MOST_BITS = 20, 28

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def without(docs: DataFrame, number: str, rows: DataFrame) -> DataFrame:
    """docs without the rows whose numbers, in the column `number` of both, are in `rows`; nor has the result that column.

    The numbers have to be written ones (see `numbered`). Few rows are broadcast, if the planner finds the written table
    small enough; many are joined.
    """
    return docs.join(table(rows.select(number)), number, "left_anti").drop(number)


def smallest(rows: DataFrame, n: int, order: str, total: DataFrame) -> DataFrame:
    """The n rows of the smallest `order`, a 64-bit hash, about as many as `total` has; fewer if some lack there.

    First the hash is bounded so that about 4 n rows are left, so the task that sorts them gets as many however many
    partitions there are.
    """
    share = 4 * n / max(1, total.count())
    if share < 1:
        rows = rows.where(F.col(order) < F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(*[order, *sorted(c for c in rows.columns if c != order)]).limit(n)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES, or of the session's own size if it has set one; a longer row is a batch of its own.

    Spark reads the size when the query runs, so it stays set in the session.
    """
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if size not in conf.getAll:
        conf.set(size, str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what it no longer uses: idle workers stay, and count as memory of the executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    for powers in (BYTE_POWERS, WORD_POWERS):
        powers.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # an allocator other than glibc's


class Bitmap:
    """The high bits of some 64-bit hashes, as a first test; false positives are possible, misses are not."""

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: one column `token`; n: about how many."""
        self.bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
        place = F.shiftrightunsigned("token", 64 - self.bits)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - self.bits}) & 63 as int))")
        # A row for each 64 bits of the bitmap at the most, so bounded.
        words = hashes.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return np.flatnonzero(self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))


def row_number(row_col: str | None) -> Column:
    """The column that numbers the rows, or numbers made anew, which hold within one job only."""
    return F.monotonically_increasing_id() if row_col is None else F.col(row_col)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes: first row, row after the last, bytes, offsets from 0."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Powers:
    """base ** i modulo 2 ** 64, and the inverses, for rolling hashes over prefixes."""

    def __init__(self, base: int):
        self.base = base | 1
        self.forget()

    def forget(self) -> None:
        self.n = 0
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, STEP_BYTES + 64)
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, np.uint64(b), np.uint64))])
                for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.up[: n + 1], self.down[: n + 1]


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
#: A random 64-bit value for each byte.
BYTE_VALUES = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place of which any good mixer would do."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """sums[j] - sums[i], times base ** -i, hashes values[i:j] by content alone."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.upto(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span start:end."""
    down = powers.upto(len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes within a row: starts, ends and rows."""
    n = len(member)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    starts = np.flatnonzero(member & (~before | first[:n]))
    ends = np.flatnonzero(member & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
