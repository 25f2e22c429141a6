"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg's naming, over fixed-size blocks).

Each normalised text is split into blocks of `block_chars` characters. The distinct blocks are sorted and numbered, so a number
stands for one block and no other. Then adjacent pairs of numbers are named in the same way, again and again, until
every document has one number: two documents have the same one if and only if their texts are equal.

DataFrame functions only. Blocks cross the network once, after a map-side combine that leaves one copy of each block
a task; what is joined back is keyed by a 128-bit hash that is checked to be collision-free over all blocks (if it is
not, the blocks are named again with another seed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import row_number, text_or_empty
from millrace.sources.shared import cut, table

#: The runs that are not one plain space already; single spaces need no replacement.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def blocks_of(text: Column, size: int) -> Column:
    """The text in pieces of `size` characters; an empty one is one empty piece. One pass over the text, however long it is."""
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def numbered(names: DataFrame, by: list[str]) -> DataFrame:
    """An integer for each row, in sorted order within each task: what a task numbers depends on its rows alone."""
    return names.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(k1, k2, name) for the distinct blocks, and the seed under which (k1, k2) is collision-free."""
    for seed in range(8):
        names = numbered(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")), ["block"])
        names = cut(names.select(*keys(F.col("block"), seed), "name"))
        if names.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return names, seed
    raise ArithmeticError("no seed without collisions")


def keys(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(block, F.lit(seed + 1)).alias("k2")]


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8192, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, id, sha (of the normalised text), n_blocks, name.

    (n_blocks, name) is the identity. Null text counts as empty. Null and repeated ids are kept apart by `row`.
    """
    # `row` keeps repeated and null ids apart and breaks ties between them.
    base = docs.select(row_number(row_col).alias("row"), F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("data"))
    names, seed = block_names(base.select(F.explode(blocks_of(F.col("data"), block_chars)).alias("block")))
    # What is exploded are the blocks' keys, and neither the text nor the list of all keys is asked for afterwards, so no
    # block's row holds a copy of them.
    hashed = F.transform(blocks_of(F.col("data"), block_chars), lambda b: F.struct(*keys(b, seed)))
    n_blocks = F.floor((F.greatest(F.length("data"), F.lit(1)) - 1) / block_chars + 1).cast("long")
    base = base.select("row", "id", F.unhex(F.sha2(F.col("data"), 256)).alias("sha"), n_blocks.alias("n_blocks"), hashed.alias("blocks"))
    pieces = base.select("row", "id", "sha", "n_blocks", F.posexplode("blocks").alias("pos", "block"))
    keyed = pieces.select("row", "id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n_blocks", F.col("pos").cast("long").alias("pos"), "block.*")
    now = table(keyed.join(names, ["k1", "k2"]).select("row", "id", "sha", "n_blocks", "pos", "name"))
    most, covered = now.agg(F.max("n_blocks").alias("m")).first()["m"] or 1, 1
    done = now.where("n_blocks = 1")
    while covered < most:
        pairs = now.where(F.col("n_blocks") > covered).groupBy("row", "id", "n_blocks", F.floor(F.col("pos") / 2).alias("half")).agg(
            F.max("sha").alias("sha"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = table(pairs)
        # As a table of its own: Spark splits a frequent pair's rows only where no aggregate stands below the join.
        named = table(numbered(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"]).drop("n"))
        now = pairs.join(named, ["a", "b"]).select("row", "id", "sha", "n_blocks", F.col("half").alias("pos"), "name")
        covered *= 2
        done = done.unionByName(now.where(F.col("n_blocks") <= covered))
    return done.select("row", "id", "sha", "n_blocks", "name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8192, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, the id column, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; null ids come last; of repeated ids one row stays. Null text
    counts as empty, so null and empty texts are one group. A text of any length is cut in one pass. An empty table gives
    no rows. Other columns are ignored. `row` is the column row_col if that is given, else numbered anew.
    """
    rows = cut(identities(docs, id_col, text_col, block_chars, row_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))
    # As a table of its own: Spark splits a large group's rows only where no aggregate stands below the join.
    groups = table(rows.groupBy("n_blocks", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, ["n_blocks", "name"]).select(
        "row",
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
