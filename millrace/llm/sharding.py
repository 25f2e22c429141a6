"""Sharding by jump consistent hashing (Lamping and Veach): a key and the number of shards decide, without a table.

The generator's 64-bit state is kept as two halves of 32 bits in longs, so that no step overflows; the whole loop is
one higher-order SQL function. Appending a shard moves rows only into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.llm.common import text_or_empty
from millrace.sources.shared import table

#: The multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
MASK = (1 << 32) - 1


def _times32(x: Column, y: int) -> Column:
    """x * y modulo 2 ** 32 for 0 <= x, y < 2 ** 32."""
    return ((x.bitwiseAND(F.lit(0xFFFF)) * y) + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The state after one step: state * MULTIPLIER + 1 modulo 2 ** 64."""
    m1, m0 = MULTIPLIER >> 32, MULTIPLIER & MASK
    low = lo.bitwiseAND(F.lit(0xFFFF)) * m0 + 1
    mid = F.shiftright(lo, 16) * m0
    low = low + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(mid, 16)
    return (carry + _times32(hi, m0) + _times32(lo, m1)).bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK))


def jump_hash(key: Column, *shards: int) -> Column:
    """A struct s<n> with the key's shard among n, for each n in shards. A null key counts as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"), zero.alias("j"), *[zero.alias(f"s{n}") for n in shards]
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        j = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        own = [F.when(s["j"] < n, s["j"]).otherwise(s[f"s{n}"]).alias(f"s{n}") for n in shards]
        # j grows in every step, so as many steps as shards reach the end.
        return F.struct(hi.alias("hi"), lo.alias("lo"), F.least(j, F.lit(max(shards)).cast("long")).alias("j"), *own)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(shards) + 1)), start, step)


#: A boundary id's rows are counted in so many parts, in which equal texts are dealt out too.
PARTS = 64


def shard_key(docs: DataFrame, id_col: str) -> Column:
    """What places a row: a whole number itself, an id of another type by its text's hash. Null stays null."""
    return F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = 256) -> DataFrame:
    """One row per row of docs: the id column, size, text_crc32, law ('key'), shard, slot, grown_shard (with one more).

    size: UTF-8 bytes of the text (null: none) plus 1. Whole numbers are keys themselves, ids of other types by the hash
    of their text; a null id is placed as 0. slot counts from 0 without gaps in each shard, by ranges of keys; rows of
    one id are numbered in any order. An empty table gives no rows. Other columns are ignored.

    Slots need no shard in one task: keys are cut into ranges at quantiles, a key that is a boundary (so perhaps a
    frequent one) is a range of its own, cut again by its texts and within equal texts, and a range's first slot comes from
    the counts. What decides a slot is written once, without the texts, so counts and numbers agree.
    """
    data = F.encode(text_or_empty(text_col), "UTF-8")
    key = shard_key(docs, id_col)
    rows = docs.select(
        F.col(id_col).alias("id"), key.alias("key"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), jump_hash(key, shards, shards + 1).alias("jump"), F.monotonically_increasing_id().alias("row")
    )
    rows = table(rows.select("id", "key", "size", "text_crc32", "row", F.col(f"jump.s{shards}").cast("int").alias("shard"), F.col(f"jump.s{shards + 1}").cast("int").alias("grown_shard")))
    edges = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    at = F.lit(len(edges) * 2 + 1)
    if edges:
        edge = F.lit(edges)
        at = F.when(F.col("key").isNull(), at).otherwise(2 * F.size(F.filter(edge, lambda x: x < F.col("key"))) + F.array_contains(edge, F.col("key")).cast("int"))
    within = F.when(at % 2 == 1, F.pmod(F.xxhash64("text_crc32", "row"), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"range": at, "within": within})
    counts = rows.groupBy("shard", "range", "within").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("range", "within").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("shard", "range", "within", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "range", "within").orderBy(F.col("key").asc_nulls_last(), "text_crc32", "row")
    placed = rows.withColumn("at", F.row_number().over(inside)).join(firsts, ["shard", "range", "within"])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"
    )
