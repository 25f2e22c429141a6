"""Suffix-array dedup: removal of every byte covered by a string of `length` bytes that also starts elsewhere.

Strings are dealt out so that equal ones meet: within each string of `length` bytes, the least of its rolling hashes of
`gram` bytes (the first, of equal ones) is its anchor. Consecutive strings of a document mostly share an anchor and make a
stretch, of about 150 starts; equal strings have equal anchors at the same place, so the hash at the anchor is the key of
the exchange. A key that occurs once holds no repeated string. Equal stretches of a key are one class; if there are several
members, all its strings are repeated.

What is left are classes of one stretch whose key has other classes: texts that agree in part. One stretch of every class
of such keys goes to shards of about `shard_bytes`, keys kept whole. Each shard's suffix array is induced and
the common prefixes of neighbours tell which strings occur twice.

A key with more than `crowd` classes is not gathered: its strings are counted by a 128-bit hash each.

Strings of bytes miss a short passage: `passage` words may well be fewer than `length` bytes. So passages of that many
words that stand in several documents, letter case and white space apart, are reported besides, though not removed. They
are found with the same stretches, of words in place of bytes, and counted by 128-bit hashes where classes differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BATCH_BYTES, BYTE_POWERS, BYTE_VALUES, LOWER, SPACE, WORD_POWERS, Powers, map_batches, mixed, prefix_sums, span_hashes, spans_of, steps, text_or_empty, utf8
from millrace.llm.suffix_array import common_with_previous, suffix_array
from millrace.sources.shared import bucketed, table

#: Starts of strings that a step looks at in one document.
REACH = 1 << 20
ANCHOR_BITS = 40
STRETCH = "key long, class long, row long, start long, size int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - span :]) if width > span else least


def symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, Powers]:
    """A value for each byte, or for each word (runs of anything but white space, A-Z lower-cased), and the offsets of the rows."""
    if not words:
        return BYTE_VALUES[data], offsets, BYTE_POWERS
    starts, ends, row = spans_of(~SPACE[data], offsets)
    values = span_hashes(prefix_sums(BYTE_VALUES[LOWER[data]], BYTE_POWERS), starts, ends, BYTE_POWERS)
    return values, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))]), WORD_POWERS


def stretches_of(values: np.ndarray, powers: Powers, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Prefix sums, hashes of grams, each string's anchor and the first string of each stretch, of documents laid end to end."""
    n = len(values)
    sums = prefix_sums(values, powers)
    down = powers.upto(n)[1]
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = _sliding_min((grams >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)) | place, length - gram + 1) & np.uint64((1 << (64 - ANCHOR_BITS)) - 1)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return sums, grams, anchor.astype(np.int64), first


def stretches(docs: DataFrame, length: int, gram: int, words: bool = False) -> DataFrame:
    """(key, class, row, start, size): stretches of all documents; class tells apart the contents under one key."""

    def emit(row: np.ndarray, base: np.ndarray, values: np.ndarray, offsets: np.ndarray, powers: Powers) -> Iterator[pa.RecordBatch]:
        """base: of each row, the place in its document with which its values begin."""
        if len(values) < length:
            return
        sums, grams, anchor, first = stretches_of(values, powers, length, gram)
        starts = len(anchor)
        # Strings stay within a row: cut stretches at a row's first start and after its last.
        begin, end = offsets[:-1], np.minimum(offsets[1:] - length + 1, starts)
        good = end > begin
        cuts = np.unique(np.concatenate([first, begin[good], end[good & (end < starts)]]))
        stop = np.append(cuts[1:], starts)
        of = np.searchsorted(offsets, cuts, "right") - 1
        keep = stop <= end[of]
        cuts, stop, of = cuts[keep], stop[keep], of[keep]
        at = anchor[cuts]
        size = stop - cuts + length - 1
        content = span_hashes(sums, cuts, cuts + size, powers)
        kind = mixed(content ^ mixed((at - cuts).astype(np.uint64) + np.uint64(1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams[at].view(np.int64)), pa.array(kind.view(np.int64)), pa.array(row[of]), pa.array(cuts - offsets[of] + base[of]), pa.array(size.astype(np.int32))],
            names=["key", "class", "row", "start", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for low, high, data, offsets in steps(batch.column(1)):
                values, offsets, powers = symbols(data, offsets, words)
                if len(values) <= 2 * REACH:
                    yield from emit(rows[low:high], np.zeros(high - low, np.int64), values, offsets, powers)
                else:
                    for at in range(0, max(1, len(values) - length + 1), REACH):
                        part = values[at : at + REACH + length - 1]
                        yield from emit(rows[low:high], np.array([at]), part, np.array([0, len(part)]), powers)

    return map_batches(docs.select("row", "text"), run, STRETCH)


def repeated_in_shards(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(row, first, last): starts of repeated strings, from first to before last, in stretches that occur once.

    pieces: key, row, start, once, data. A task streams its keys in order and sorts a shard whenever enough bytes are
    there; no key is split.
    """

    def solve(parts: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        ends = np.cumsum([len(p[4]) for p in parts])
        begins = ends - [len(p[4]) for p in parts]
        valid = np.zeros(len(text), bool)
        for a, b in zip(begins, ends):
            valid[a : b - length + 1] = True
        sa = suffix_array(text, length)
        sa = sa[valid[sa]]
        shared = common_with_previous(text, sa) >= length
        hit = np.zeros(len(text) + 1, bool)
        hit[sa[shared]] = True
        hit[sa[:-1][shared[1:]]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        of = np.searchsorted(ends, first, "right")
        once = np.array([p[3] for p in parts])[of]
        first, last, of = first[once], last[once], of[once]
        row, start = (np.array([p[i] for p in parts], np.int64)[of] for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start + first - begins[of]), pa.array(start + last - begins[of])], names=["row", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, key = [], 0, None
        for batch in batches:
            for k, row, start, once, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_bytes and k != key:
                    yield solve(parts)
                    parts, size = [], 0
                parts.append((k, row, start, once, data))
                size, key = size + len(data), k
        if parts:
            yield solve(parts)

    return map_batches(pieces.select("key", "row", "start", "once", "data"), run, "row long, first long, last long")


def cut_pieces(rows: DataFrame) -> DataFrame:
    """rows (row, text, wanted) to (key, classes, once, start, row, data): of each text the bytes of the stretches that are wanted.

    A text is taken once, whatever the number of its stretches, and gives batches of some BATCH_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, wanted in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("wanted")):
                data, _ = utf8(pa.array([text.as_py()], pa.string()))
                fields = {f: wanted.values.field(f) for f in ("key", "classes", "once", "start", "size")}
                start, size = fields["start"].to_numpy(), fields["size"].to_numpy()
                bounds = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // BATCH_BYTES, prepend=0, append=-1))
                first = 0
                for last in np.unique(np.append(bounds[bounds > 0], len(size))).tolist():
                    cuts = [data[a : a + n].tobytes() for a, n in zip(start[first:last].tolist(), size[first:last].tolist())]
                    part = [fields[f].slice(first, last - first) for f in ("key", "classes", "once", "start")]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(cuts), row)), pa.array(cuts, pa.binary())], names=["key", "classes", "once", "start", "row", "data"])
                    first = last

    return map_batches(rows.select("row", "text", "wanted"), run, "key long, classes long, once boolean, start long, row long, data binary")


def counted_singly(pieces: DataFrame, length: int) -> DataFrame:
    """The same result by counting each string's hash: for keys with too many classes to gather."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, once, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                values = BYTE_VALUES[np.frombuffer(data, np.uint8)]
                at = np.arange(len(data) - length + 1)
                one, two = (span_hashes(prefix_sums(values, p), at, at + length, p).view(np.int64) for p in (BYTE_POWERS, WORD_POWERS))
                columns = [pa.array(one), pa.array(two), pa.array(np.full(len(at), row)), pa.array(at + start), pa.array(np.full(len(at), once))]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "row", "first", "once"])

    singles = table(map_batches(pieces.select("key", "row", "start", "once", "data"), run, "h1 long, h2 long, row long, first long, once boolean"))
    many = table(singles.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")).hint("merge")
    return singles.where("once").join(many, ["h1", "h2"]).select("row", "first", (F.col("first") + 1).alias("last"))


def shared_passages(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, first, last): words, from first to before last, at which a run of `length` words starts that another document holds."""
    found = table(stretches(rows, length, gram, words=True))
    keys = found.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b")
    shared = table(found.join(table(keys.select("key")), "key"))
    ends = F.min("row").alias("a"), F.max("row").alias("b")
    classes = shared.groupBy("key", "class").agg(*ends, F.min(F.struct("row", "start", "size")).alias("one"))
    classes = table(classes.select("key", "class", (F.col("a") < F.col("b")).alias("several"), "one"))
    several = classes.where("several").select("key", "class").hint("merge")
    whole = shared.join(several, ["key", "class"]).select("row", F.col("start").alias("first"), (F.col("start") + F.col("size") - length + 1).alias("last"))
    # Where a key has several classes, those of one document are compared run by run with one of each other class.
    open_keys = table(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    opened = classes.join(open_keys, "key")
    lone = shared.join(opened.where("not several").select("key", "class").hint("merge"), ["key", "class"])
    places = lone.select("row", "start", "size", F.lit(False).alias("several")).unionByName(opened.where("several").select("one.*", "several"))
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("start", "size", "several")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data, offsets = utf8(pa.array([text.as_py()], pa.string()))
                values, _, _ = symbols(data, offsets, True)
                start, size, several = (np.array([p[c] for p in places]) for c in ("start", "size", "several"))
                many = size - length + 1
                at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
                one, two = (span_hashes(prefix_sums(values, p), at, at + length, p).view(np.int64) for p in (BYTE_POWERS, WORD_POWERS))
                columns = [pa.array(one), pa.array(two), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int64)), pa.array(np.repeat(several, many))]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "row", "first", "several"])

    runs = table(map_batches(rows.select("row", "text").join(wanted, "row").select("row", "text", "wanted"), run, "h1 long, h2 long, row long, first long, several boolean"))
    met = table(runs.groupBy("h1", "h2").agg(*ends, F.max("several").alias("s")).where("a < b or s").select("h1", "h2")).hint("merge")
    part = runs.where("not several").join(met, ["h1", "h2"]).select("row", "first", (F.col("first") + 1).alias("last"))
    return whole.unionByName(part)


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    gram: int = 100,
    shard_bytes: int = 1 << 20,
    crowd: int = 2048,
    passage: int = 51,
) -> DataFrame:
    """One row per row of docs: row, the id column, n_bytes, spans (removed: first, last + 1, maximal), kept (binary), passages.

    Strings are of UTF-8 bytes and never cross rows; they are judged on the input. passages: the maximal runs of words
    (first, last + 1) covered by `passage` words that stand in another row too, whether or not they are removed. Null and
    empty texts have no bytes. Null and repeated ids are rows of their own, so a repeated row's text repeats. An empty
    table gives no rows. Other columns are ignored.

    Rows are numbered once, in a table dealt out by that number, so later joins by it do not move the texts.
    """
    rows = bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "row")
    found = table(stretches(rows, length, gram))
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("n > 1")
    # As a table of its own: Spark splits a frequent key's rows only where no aggregate stands below the join.
    keys = table(keys.select("key", (F.col("a") == F.col("b")).alias("alone")))
    shared = table(found.join(keys, "key"))
    mixed_keys = shared.where("not alone")
    classes = mixed_keys.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "size")).alias("one"))
    classes = table(classes)
    # Only keys with a class of one member are left to sort.
    open_keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where("least = 1").drop("least")
    samples = classes.join(table(open_keys), "key").select("key", "classes", (F.col("n") == 1).alias("once"), "one.*")
    wanted = samples.groupBy("row").agg(F.collect_list(F.struct("key", "classes", "once", "start", "size")).alias("wanted"))
    pieces = table(cut_pieces(rows.select("row", "text").join(wanted, "row")))
    in_shards = repeated_in_shards(pieces.where(F.col("classes") <= crowd).repartition("key").sortWithinPartitions("key"), length, shard_bytes)
    singly = counted_singly(pieces.where(F.col("classes") > crowd), length)
    # A merge join: of the joins that deal out both sides, the one whose frequent keys Spark splits.
    several = classes.where("n > 1").select("key", "class").hint("merge")
    whole = shared.where("alone").select("row", "start", "size").unionByName(mixed_keys.join(several, ["key", "class"]).select("row", "start", "size"))
    whole = whole.select("row", F.col("start").alias("first"), (F.col("start") + F.col("size") - length + 1).alias("last"))
    hit = whole.unionByName(in_shards).unionByName(singly)
    spans = hit.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("hit"))
    met = shared_passages(rows, passage, max(1, passage // 4)).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("met"))
    return removed(rows.join(spans, "row", "left").join(met, "row", "left"), length, passage, id_col)


def covered(hit: pa.ListScalar, length: int, size: int) -> np.ndarray:
    """Which of `size` places lie in a string of `length` that starts in one of the ranges of `hit`."""
    if hit.as_py() is None:
        return np.zeros(size, bool)
    first, last = (hit.values.field(f).to_numpy() for f in ("first", "last"))
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last - 1 + length, -1)
    return np.cumsum(change[:-1]) > 0


def runs_of(member: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    return [{"first": a, "last": b} for a, b in edges.reshape(-1, 2).tolist()]


def removed(rows: DataFrame, length: int, passage: int, id_col: str) -> DataFrame:
    """Takes out the bytes covered by the strings that start at each of `hit`, and names the words that those of `met` cover."""
    spans_type = "array<struct<first:long,last:long>>"
    schema = f"row long, `{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, spans {spans_type}, kept binary, passages {spans_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"first": pa.int64(), "last": pa.int64()}))
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            spans, kept, passages = [], [], []
            for i, (hit, met) in enumerate(zip(batch.column(3), batch.column(4))):
                mine = data[offsets[i] : offsets[i + 1]]
                gone = covered(hit, length, len(mine))
                spans.append(runs_of(gone))
                kept.append(mine[~gone].tobytes())
                # No more words than bytes.
                passages.append(runs_of(covered(met, passage, len(mine))) if met.is_valid else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(passages, kind)],
                names=["row", id_col, "n_bytes", "spans", "kept", "passages"],
            )

    return map_batches(rows.select("row", "id", "text", "hit", "met"), run, schema)
