"""Pairs of texts whose sets of shingles of five words have a Jaccard similarity of at least 0.8, candidates from MinHash bands.

Two texts are candidates if all ROWS minima of one of BANDS bands are equal. At similarity s that fails for a pair with
probability (1 - s ** ROWS) ** BANDS: 6e-5 at 0.8, less above. Candidates are verified by their sets of 64-bit shingle
hashes, so no pair below the bound is linked.

Where more than `crowd` texts share a band, each is first compared with the least of them only. A band that then holds
several components is not paired off. Its texts join the group of the component that most of them are in, and each group has a
center: the shingles that over half of its texts hold. Two texts differ in just what one of their differences from the center has
and the other has not, so of two that are similar enough
- either their differences are so few that the text nearest to the center is similar to both: one link each, or
- they have some differences in common: these texts meet by an exact prefix-filtered join of the differences, ordered by the number
  of texts that have them, the rarest first.
What most texts of a group share is no difference, and makes no pairs. So no pair of two components of a band is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import BYTE_POWERS, BYTE_VALUES, LOWER, SPACE, WORD_POWERS, Bitmap, map_batches, mixed, prefix_sums, span_hashes, spans_of, steps, text_or_empty
from millrace.sources.shared import table

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Bytes of one text whose words are hashed at once.
WINDOW = 1 << 20
#: An odd multiplier for each minimum, and for each place in a band.
FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, BANDS * ROWS + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(data: np.ndarray, width: int, limit: int) -> Iterator[np.ndarray]:
    """Stretches of a text of some `limit` bytes, each of `width` words or more, such that each run of `width` words is in
    just one; the whole text if it has fewer words."""
    first = 0
    while first < len(data):
        size = limit
        while True:
            last = first + size
            blank = np.flatnonzero(SPACE[data[last : last + limit]])[:1] if last < len(data) else None
            if blank is not None and not len(blank):  # a word of more than limit bytes
                size += limit
                continue
            last = len(data) if blank is None else last + int(blank[0])
            inner = ~SPACE[data[first:last]]
            starts = np.flatnonzero(inner & np.append(True, ~inner[:-1])) if len(inner) else inner
            if len(starts) >= width or blank is None:
                break
            size *= 2
        if len(starts) >= width or first == 0:
            yield data[first:last]
        if last == len(data):
            return
        first += int(starts[-(width - 1)]) if width > 1 else last - first


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles and the offsets of the rows; of a text of fewer words, of all of them.

    A-Z are lower-cased, and only \\x20 and \\x09-\\x0D part words. One long text is taken window by window, so that no more
    than the 8 bytes of each hash grow with it.
    """
    if len(offsets) > 2 or len(data) <= 2 * WINDOW:
        return _shingles(data, offsets, width)
    found = np.concatenate([np.empty(0, np.uint64), *(_shingles(w, np.array([0, len(w)]), width)[0] for w in windows(data, width, WINDOW))])
    return found, np.array([0, len(found)])


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = spans_of(~SPACE[data], offsets)
    words = span_hashes(prefix_sums(BYTE_VALUES[LOWER[data]], BYTE_POWERS), starts, ends, BYTE_POWERS)
    counts = np.bincount(rows, minlength=n)
    held = np.maximum(counts - width + 1, np.minimum(counts, 1))
    first, at = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (counts, held))
    row = np.repeat(np.arange(n), held)
    start = np.arange(at[-1]) - at[row] + first[row]
    return span_hashes(prefix_sums(words, WORD_POWERS), start, np.minimum(start + width, first[row + 1]), WORD_POWERS), at


def marks(column: pa.Array, width: int = WIDTH) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text a hash of its set of shingles, the size of the set and the keys of its bands; no key without words."""
    sets, sizes = np.zeros(len(column), np.uint64), np.zeros(len(column), np.int64)
    keys = np.zeros((len(column), BANDS), np.uint64)
    for first, last, data, offsets in steps(column):
        hashes, at = shingles(data, offsets, width)
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            continue
        for i in some:
            own = np.unique(hashes[at[i] : at[i + 1]])
            sets[first + i], sizes[first + i] = mixed(own).sum(dtype=np.uint64), len(own)
        begins = at[some]
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for r in range(ROWS):
                key += mixed(np.minimum.reduceat(hashes * FACTORS[band * ROWS + r], begins)) * FACTORS[BANDS * ROWS + r]
            keys[first + some, band] = mixed(key)
    held = np.where(sizes > 0, BANDS, 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(keys[sizes > 0].ravel().view(np.int64)))
    return pa.array(sets.view(np.int64)), pa.array(sizes), lists


def some_texts(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """docs (row, text, token), and what leaves of a batch of them the rows of `wanted` and few others.

    A bitmap of bounded size spares the texts a join, in which all of them would be moved for a few.
    """
    tokens = wanted.select(F.xxhash64("row").alias("token"))
    handle = docs.sparkSession.sparkContext.broadcast(Bitmap(tokens, tokens.count()))
    return docs.select("row", "text", F.xxhash64("row").alias("token")), lambda batch: batch.take(pa.array(handle.value(batch.column(2).to_numpy().view(np.uint64))))


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(row, held) of docs (row, text), of the rows of `wanted` at least: the sorted distinct hashes as bytes."""
    docs, chosen = some_texts(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(chosen, batches):
            held = []
            for _, _, data, offsets in steps(batch.column(1)):
                hashes, at = shingles(data, offsets, width)
                held += [np.unique(hashes[a:b]).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["row", "held"])

    return map_batches(docs, run, "row long, held binary")


def set_rows(sets: DataFrame) -> DataFrame:
    """(main, h) of sets (main, held): a row for each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for main, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.frombuffer(held.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), main, np.int64)), pa.array(h)], names=["main", "h"])

    return map_batches(sets.select("main", "held"), run, "main long, h long")


def differences(texts: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """texts (main, row, fp, size, root), with the differences `h` of each from the center of its group `main`; docs has row and text.

    excess: how many more these are than half of what two texts of this size may differ in. Two are similar if the sum of theirs is at
    most twice the number of differences in common. near: those of the text of the least excess (excess, row, fp, root).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for held, center in zip(batch.column(5), batch.column(6)):
                center = center.values.to_numpy() if center.is_valid else np.empty(0, np.int64)
                found.append(np.setxor1d(np.frombuffer(held.as_py(), np.int64), center, assume_unique=True))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists], names=["main", "row", "fp", "size", "root", "h"])

    sets = table(texts.join(shingle_sets(docs, texts, width), "row").select("main", "row", "fp", "size", "root", "held"))
    often = table(set_rows(sets).groupBy("main", "h").agg(F.count(F.lit(1)).alias("n")))
    total = table(sets.groupBy("main").agg(F.count(F.lit(1)).alias("total")))
    center = table(often.join(total, "main").where("2 * n > total").groupBy("main").agg(F.collect_list("h").alias("center")))
    apart = map_batches(sets.join(center, "main", "left"), run, "main long, row long, fp long, size long, root long, h array<long>")
    apart = table(apart.withColumn("excess", F.size("h") - F.col("size") * (1 - similarity) / (1 + similarity)))
    near = table(apart.groupBy("main").agg(F.min(F.struct("excess", "row", "fp", "root", "size")).alias("near")))
    return apart.join(near, "main")


def prefixes(found: DataFrame) -> DataFrame:
    """found (main, row, fp, size, root, excess, apart, low, h) once for each difference `h` of its prefix that one that is apart has in common with it.

    low: the least excess in the group; apart: whether it is not linked with the text of that. rest: as many of the text's
    differences come no sooner than h in the order.
    """
    each = found.withColumn("h", F.explode("h"))
    often = table(each.groupBy("main", "h").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("met")).where("n > 1 and met").drop("met"))
    common = each.join(often, ["main", "h"])
    own = W.partitionBy("main", "row")
    # Those that no other text has come first in the order, and can't meet.
    rest = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("n", "h")) + 1
    # What is not apart meets what is, whose excess is over -low.
    least = F.col("excess") + F.when(F.col("apart"), F.col("low")).otherwise(-F.col("low"))
    placed = common.withColumn("rest", rest).where(2 * F.col("rest") >= least - 1e-6)
    return table(placed.select("main", "h", "rest", "row", "fp", "size", "root", "excess", "apart"))


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """(u, v), of pairs (u, v, row_u, row_v), of those similar enough; docs has row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    pairs = table(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("row_u", "row_v")).alias("row")).distinct()
    held = table(shingle_sets(docs, wanted, width))
    a, b = (held.select(F.col("row").alias(f"row_{x}"), F.col("held").alias(f"held_{x}")) for x in "uv")
    # The same plan for few sets and for many: neither is ever broadcast.
    return table(map_batches(pairs.join(a.hint("merge"), "row_u").join(b.hint("merge"), "row_v").select("u", "v", "held_u", "held_v"), run, "u long, v long").distinct())


def similar_components(
    rows: DataFrame, docs: DataFrame, known: DataFrame, components: Callable, linked: Callable, row_col: str, text_col: str, similarity: float, width: int, crowd: int = 8
) -> DataFrame:
    """(node, root) over the values of fp, linked by `known` (u, v) or by a similar text of each.

    rows: row, fp and the columns of marks; row_col numbers the rows of docs alike. linked: whether two columns of fp are linked in `known` anyway.
    """
    texts = docs.select(F.col(row_col).alias("row"), text_or_empty(text_col).alias("text"))
    ones = rows.where("size > 0").groupBy("fp", "set").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    keyed = table(ones.select("fp", "row", "size", F.explode("keys").alias("key")))
    shared = table(keyed.join(table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).hint("merge"), "key"))

    def sides(u: DataFrame, v: DataFrame, where: Column, by: tuple[str, ...] = ("key",)) -> DataFrame:
        u, v = (x.select(*by, *[F.col(c).alias(f"{c}_{y}") for c in x.columns if c not in (*by, "n")]) for x, y in ((u, "u"), (v, "v")))
        sized = F.least("size_u", "size_v") >= similarity * F.greatest("size_u", "size_v") - 1e-9
        pairs = u.join(v, list(by)).where(where & sized & (F.col("fp_u") != F.col("fp_v")) & ~linked(F.col("fp_u"), F.col("fp_v")))
        return pairs.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"), "row_u", "row_v")

    few, many = shared.where(F.col("n") <= crowd), shared.where(F.col("n") > crowd)
    least = table(many.groupBy("key").agg(F.min(F.struct("row", "fp", "size")).alias("x")).select("key", "x.*"))
    pairs = sides(few, few, F.col("row_u") < F.col("row_v")).unionByName(sides(least, many, F.lit(True)))
    roots = table(components(known.select("u", "v").unionByName(verified(pairs, texts, similarity, width))))
    # Crowded bands of several components: what is outside the one that most are in has yet to meet the rest.
    placed = many.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = table(placed.select("key", "fp", "row", "size", "root"))
    counted = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    placed = placed.join(table(main.select("key", F.col("x.root").alias("main"))), "key")
    crowds = table(placed.select("main", "row", "fp", "size", "root").distinct())
    if crowds.isEmpty():
        return roots
    found = differences(crowds, texts, similarity, width)
    close = F.col("excess") + F.col("near.excess") <= 1e-6
    stars = found.where(close & (F.col("root") != F.col("near.root"))).select(F.col("fp").alias("u"), F.col("near.fp").alias("v"), F.col("row").alias("row_u"), F.col("near.row").alias("row_v"))
    found = found.withColumns({"root": F.when(close, F.col("near.root")).otherwise(F.col("root")), "low": F.col("near.excess")})
    found = table(found.withColumn("apart", F.col("root") != F.col("near.root")).drop("near"))
    meeting = prefixes(found)
    # Of two that are both apart, the one of the lesser row comes first.
    once = (F.col("root_u") != F.col("root_v")) & (~F.col("apart_v") | (F.col("row_u") < F.col("row_v")))
    # Position: at their first common difference two texts still have before them all that they have in common.
    enough = 2 * F.least("rest_u", "rest_v") >= F.col("excess_u") + F.col("excess_v") - 1e-6
    rest = sides(meeting.where("apart"), meeting, once & enough, ("main", "h"))
    more = verified(stars.unionByName(rest), texts, similarity, width)
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
