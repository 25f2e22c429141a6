"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows of benchmark items.

A window is `window` consecutive words of an item, or a shorter item as a whole. Its tokens are its shingles of five
words. All must be held, so one token is the necessary prefix: the window's rarest by the number of its places in all
documents. Documents are probed for prefix tokens only, and the probes are joined with the windows. A token's place fixes
where the window would start; bounds on position and length drop those that don't fit between the document's first and
last word, and the words themselves decide.

Windows, counts and probes are tables, so neither the benchmark nor a part of it passes through the driver, and the
documents are read twice however large it is. What is broadcast is a bitmap of tokens, of bounded size,
that spares most of a document's shingles the shuffle; where it is crowded more of them are joined in vain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BYTE_POWERS, BYTE_VALUES, LOWER, WORD_POWERS, Bitmap, map_batches, prefix_sums, row_number, span_hashes, spans_of, steps, text_or_empty
from millrace.sources.shared import table

GAPS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
SPANS = "array<struct<first:long,last:long>>"


class Step:
    """The words of a run of documents, with rolling hashes over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        self.starts, self.ends, self.row = spans_of(IS_WORD[self.low], offsets)
        sums = prefix_sums(BYTE_VALUES[self.low], BYTE_POWERS)
        self.sums = prefix_sums(span_hashes(sums, self.starts, self.ends, BYTE_POWERS), WORD_POWERS)
        self.n_words = np.bincount(self.row, minlength=len(offsets) - 1)
        self.last = np.cumsum(self.n_words)  # the word after each row's last
        self.first = self.last - self.n_words

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each run of so many words within a row."""
        at = np.arange(max(0, len(self.row) - width + 1))
        at = at[self.row[at] == self.row[at + width - 1]] if len(at) else at
        return at, span_hashes(self.sums, at, at + width, WORD_POWERS)

    def words(self, first: int, last: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last]))


def windows_of(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, words, n, width, tokens) for each window of items (item, text): its words, their number, its shingles' width and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in steps(batch.column(1)):
                step = Step(data, offsets)
                size = np.minimum(step.n_words, window)
                many = np.where(size > 0, step.n_words - size + 1, 0)
                row = np.repeat(np.arange(len(many)), many)
                begin = step.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                n = size[row]
                width = np.minimum(n, shingle)
                held = n - width + 1
                at = np.repeat(begin - (np.cumsum(held) - held), held) + np.arange(held.sum())
                tokens = span_hashes(step.sums, at, at + np.repeat(width, held), WORD_POWERS)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), pa.array(tokens.view(np.int64)))
                words = pa.array([step.words(a, b).decode() for a, b in zip(begin.tolist(), (begin + n).tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + row)), words, pa.array(n), pa.array(width), lists], names=["item", "words", "n", "width", "tokens"])

    return map_batches(items.select("item", "text"), run, f"item {items.schema['item'].dataType.simpleString()}, words string, n long, width long, tokens array<long>")


def rarity(docs: DataFrame, seen: Bitmap, widths: list[int]) -> DataFrame:
    """(token, n): places in docs (row, text, id) of the shingles in the bitmap."""
    handle = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                step = Step(data, offsets)
                for width in widths:
                    hashes = step.shingles(width)[1]
                    token, n = np.unique(hashes[handle.value(hashes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return map_batches(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def probes_of(docs: DataFrame, seen: Bitmap, widths: list[int], window: int) -> DataFrame:
    """For each row of docs (row, text, id) one row with its id and n_words and no token, and one for each place of a
    shingle in the bitmap: token, at (its first word), and around it the words (`near`) that a window may take, `lead` of them before."""
    handle = docs.sparkSession.sparkContext.broadcast(seen)
    schema = f"row long, id {docs.schema['id'].dataType.simpleString()}, n_words long, token long, at long, near string, lead long"
    names = ["row", "id", "n_words", "token", "at", "near", "lead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            ids = batch.column(2)
            for low, high, data, offsets in steps(batch.column(1)):
                step = Step(data, offsets)
                n_words[low:high] = step.n_words
                for width in widths:
                    start, hashes = step.shingles(width)
                    found = handle.value(hashes)
                    at, row = start[found], step.row[start[found]]
                    first, last = np.maximum(at - (window - width), step.first[row]), np.minimum(at + window, step.last[row])
                    near = pa.array([step.words(a, b).decode() for a, b in zip(first.tolist(), last.tolist())], pa.string())
                    held = [batch.column(0).take(pa.array(low + row)), pa.nulls(len(at), ids.type), pa.array(step.n_words[row])]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(hashes[found].view(np.int64)), pa.array(at - step.first[row]), near, pa.array(at - first)], names=names)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(n_words), none, none, pa.nulls(batch.num_rows, pa.string()), none], names=names)

    return map_batches(docs.select("row", "text", "id"), run, schema)


def merged(docs: DataFrame, id_col: str) -> DataFrame:
    """docs (row, id, n_words, spans, items) with spans that overlap or touch made one; no span for null."""
    kind = pa.list_(pa.struct({"first": pa.int64(), "last": pa.int64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(3):
                if not found.is_valid:
                    out.append([])
                    continue
                first, last = (found.values.field(f).to_numpy() for f in ("first", "last"))
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                head = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
                tail = np.append(head[1:], len(first)) - 1
                out.append([{"first": a, "last": b} for a, b in zip(first[head].tolist(), last[tail].tolist())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind), batch.column(4)], names=["row", id_col, "n_words", "spans", "items"])

    kinds = dict(docs.dtypes)
    return map_batches(docs.select("row", "id", "n_words", "spans", "items"), run, f"row long, `{id_col}` {kinds['id']}, n_words long, spans {SPANS}, items {kinds['items']}")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 5,
    share: int = 20,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: row, the id column, n_words, spans, items, n_hit, contaminated.

    spans: the maximal runs of hit words (first, last + 1). items: the items with windows that occur, distinct and sorted.
    contaminated: some word is hit and n_hit is at least a `share`-th of n_words. Null and empty text has no words.
    Items without words, with null text or null id are passed over; a repeated item counts once. With no item every
    document is clean; no documents give no rows. Null and repeated document ids give rows of their own. Ids may be of
    any type that can be grouped. Other columns are ignored. `row` is the column row_col if that is given, else numbered anew.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    raw = table(windows_of(items, window, shingle))
    # A window's words decide all else of it.
    windows = table(raw.groupBy("words").agg(*[F.first(c).alias(c) for c in ("n", "width", "tokens")]))
    tokens = windows.select("words", "n", "width", F.posexplode("tokens").alias("offset", "token"))
    said = windows.agg(F.sum(F.size("tokens")).alias("n"), F.collect_set("width").alias("widths")).first()
    widths = sorted(said["widths"])

    rows = docs.select(row_number(row_col).alias("row"), text_or_empty(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = table(rarity(rows, Bitmap(tokens.select("token"), said["n"] or 0), widths))
    # A token that is not counted is nowhere, and so is a window that holds it.
    rarest = F.min(F.struct(F.coalesce(F.col("places"), F.lit(0)).alias("places"), "token", "offset")).alias("x")
    chosen = tokens.join(counts.withColumnRenamed("n", "places"), "token", "left").groupBy("words", "n", "width").agg(rarest)
    chosen = table(chosen.where("x.places > 0").select("words", "n", "width", "x.token", "x.offset"))

    probes = table(probes_of(rows, Bitmap(chosen.select("token"), chosen.count()), [r["width"] for r in chosen.select("width").distinct().collect()], window))
    # Position: not before the document's first word. Length: not beyond its last.
    begin = F.col("at") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
    here = F.array_join(F.slice(F.split("near", " "), (F.col("lead") - F.col("offset") + 1).cast("int"), F.col("n").cast("int")), " ")
    met = probes.where("token is not null").join(chosen, "token").where(fits).where(here == F.col("words"))
    met = table(met.select("row", begin.alias("first"), (begin + F.col("n")).alias("last"), "words"))
    spans = met.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    held = met.select("row", "words").distinct().join(table(raw.select("words", "item").distinct()), "words")
    named = held.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = probes.where("token is null").select("row", "id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    none = F.array().cast(dict(named.dtypes)["items"])
    out = merged(out.withColumn("items", F.coalesce("items", none)), id_col)
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
