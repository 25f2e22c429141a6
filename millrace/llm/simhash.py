"""Near-dedup: SimHash fingerprints linked within a Hamming distance of 2, candidates from Golay-code keys.

The perfect binary Golay code puts each 23-bit word within 3 bits of exactly one codeword. Words that differ in at most
2 bits have a word between them within 1 bit of both, so some codeword lies within 4 bits of both; a word has one
such codeword (when its own is within 2 bits) or six. Their 12-bit indices are the word's keys.

A fingerprint's 64 bits make three segments (22, 21 and 21 bits). If two fingerprints differ in at most 2 bits, one
segment is equal in both (pigeonhole), and the next one differs in at most 2 bits, so they share a Golay key there. The
join key is the equal segment with that index: about 34 bits. Candidates are verified by their Hamming distance.

Equal fingerprints are one class before anything is joined. Where more than `crowd` classes share a key, pairs are not
made: each class there is put on the 65 words within 1 bit of it, and those that meet on a word are linked to the least
of them. Such classes differ in at most 2 bits, and any two that do meet, so this is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import minhash
from millrace.llm.common import map_batches, row_number, text_or_empty
from millrace.llm.components import components
from millrace.sources.shared import table

SEED = 42
#: Lowest bit and bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, width: int = 3) -> int:
    """Each bit is 1 if it is set in over half of the hashes of the shingles of `width` words; 0 without words.

    A long text is taken window by window, so that no more than its bytes grow with it.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    parts = [data] if len(data) <= 2 * minhash.WINDOW else map(bytes, minhash.windows(np.frombuffer(data, np.uint8), width, minhash.WINDOW))
    bits, count = np.zeros(64, np.int64), 0
    for hashes in (shingle_hashes(part, width) for part in parts):
        count += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > count, bitorder="little").view("<u8")[0])


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    words = data.lower().split()  # of bytes: A-Z only, and only \x20 and \x09-\x0D part words
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    ends = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, set_width: int = 0, row_col: str | None = None) -> DataFrame:
    """(row, id, fp) for each row of docs; fp is the fingerprint as a signed long. With set_width also (set, size, keys) by minhash.marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts))
            more = minhash.marks(texts, set_width) if set_width else ()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64)), *more], names=["row", "id", "fp", "set", "size", "keys"][: 3 + len(more)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(row_number(row_col).alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, f"row long, id {kind}, fp long" + (", set long, size long, keys array<long>" if set_width else ""))


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome (11 bits): the error to take away, the further five differences of codewords, whether they count.

    The code is cyclic; the tables follow from the generator: remainders of all words of weight at most 3 are
    distinct and cover all syndromes, and five codewords of weight 7 hold any three given bits.
    """
    words = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        words ^= np.where((np.arange(1 << 12) >> bit) & 1, GENERATOR << bit, 0)
    sevens = words[np.bitwise_count(words) == 7]
    error, more = np.zeros(1 << 11, np.int64), np.zeros((1 << 11, 5), np.int64)
    bits = [1 << i for i in range(23)]
    light = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    light += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    for e in light:
        s = int(syndrome(np.array([e]))[0])
        error[s] = e
        if e.bit_count() == 3:
            more[s] = sevens[(sevens & e) == e]
    return error, more, np.bitwise_count(error) == 3


def syndrome(word: np.ndarray) -> np.ndarray:
    """The remainder by the generator."""
    word = word.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        word ^= np.where((word >> bit) & 1, GENERATOR << (bit - 11), 0)
    return word


def golay_keys(word: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The place in `word` and the key, for every codeword within 4 bits of each 23-bit word."""
    error, more, three = tables
    s = syndrome(word)
    own = word ^ error[s]
    at = np.flatnonzero(three[s])
    places = np.concatenate([np.arange(len(word)), np.repeat(at, 5)])
    codes = np.concatenate([own, (own[at, None] ^ more[s[at]]).ravel()])
    return places, codes >> 11


def segment_keys(classes: DataFrame) -> DataFrame:
    """(key, fp): for each segment, its bits with each Golay key of the next segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, (low, bits) in enumerate(SEGMENTS):
                low2, bits2 = SEGMENTS[(i + 1) % 3]
                same = ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                near = ((fp >> np.uint64(low2)) & np.uint64((1 << bits2) - 1)).astype(np.int64)
                places, codes = golay_keys(near, tables)
                key = (i << 34) | (same[places] << 12) | codes
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)[places])], names=["key", "fp"])

    return map_batches(classes.select("fp"), run, "key long, fp long")


def near(u: Column, v: Column) -> Column:
    return F.bit_count(u.bitwiseXOR(v)) <= 2


def links(classes: DataFrame, crowd: int = 48) -> DataFrame:
    """(u, v): enough links between distinct fingerprints at most 2 bits apart to join all that are so linked.

    Below `crowd` classes a key every link is made; at more, links to the least class of each crossing.
    """
    keyed = table(segment_keys(classes))
    # Counts and minima are written: Spark splits a frequent key's rows only where no aggregate stands below the join.
    sizes = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = table(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= crowd).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key").where(F.col("u") < F.col("v")).where(near(F.col("u"), F.col("v")))
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    met = many.select("fp", F.explode(around).alias("word"))
    least = table(met.groupBy("word").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    stars = met.join(least, "word").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").unionByName(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None, set_width: int = minhash.WIDTH, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, the id column, fp (signed long), fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest id that links reach; null if all ids there are null. kept marks one row of each
    component: that of the smallest id, of repeated or null ids the first row. Null and empty texts and those of white
    space have fingerprint zero and are linked like any other. An empty table gives no rows. Other columns are ignored.

    With a similarity, texts are linked besides whose sets of shingles of set_width words have that Jaccard similarity
    or more (see minhash). That reads docs twice, so row_col has to name a written column that numbers the rows.
    """
    if similarity is not None and row_col is None:
        raise ValueError("texts are read again by their row: row_col has to name a written number")
    rows = table(fingerprints(docs, id_col, text_col, width, 0 if similarity is None else set_width, row_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))).alias("first")
    classes = table(rows.groupBy("fp").agg(first))
    roots = components(links(classes)) if similarity is None else minhash.similar_components(rows, docs, links(classes), components, near, row_col, text_col, similarity, set_width)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = table(rooted)
    best = table(rooted.groupBy("root").agg(F.min("first").alias("best")))
    found = rooted.join(best, "root").select("fp", "best")
    return rows.join(found, "fp").select(
        "row",
        F.col("id").alias(id_col),
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )
