"""Connected components of an edge table: contracted within tasks, then alternating large-star and small-star (Kiveris et al.).

A task takes edges up to a bound, finds their components and gives an edge from each node to the least node of its own in
their place. Where the bound holds all edges that are left, that is the answer; else the stars join what the tasks found, in
rounds of shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches
from millrace.sources.shared import cut, table

#: Edges that a task holds at once, some 200 MB.
EDGES = 1 << 20


def contracted(edges: DataFrame, limit: int = EDGES) -> DataFrame:
    """Edges (u, v), v being the least node of a component of edges that a task holds at once, that join the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        kind, held = None, 0

        def root(x):
            at = x
            while (up := above.setdefault(at, at)) != at:
                at = up
            while x != at:
                above[x], x = at, above[x]
            return at

        def made() -> pa.RecordBatch:
            stars = [(x, r) for x in above if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], kind) for i in range(2)], names=["u", "v"])

        for batch in batches:
            kind = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    above[max(a, b)] = min(a, b)
                held += 1
                if held >= limit:
                    yield made()
                    above.clear()
                    held = 0
        if above:
            yield made()

    return map_batches(edges.select("u", "v"), run, edges.select("u", "v").schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = table(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, limit: int = EDGES) -> DataFrame:
    """(u, v) with u <> v, of any one orderable type, to (node, root): root is the least node that can be reached.

    Isolated nodes don't appear. No more than `limit` edges are one task's work. Of more, each round cuts the lineage. A
    node may be next to most others, as a root is after a round: minima combine before the shuffle and are written, so the join has no aggregate below it and Spark can split
    the node's rows.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = table(edges.where("u <> v").select("u", "v").distinct())
    if (n := edges.count()) > limit:
        edges = table(contracted(edges, limit).distinct())
        n = edges.count()
    if n <= limit:
        edges = table(contracted(edges.coalesce(1), limit))
    else:
        seen = mark(edges)
        while True:
            # Small star reads its edges twice; written, they are made once.
            edges = cut(_small_star(table(_large_star(edges).distinct())).distinct())
            now = mark(edges)
            if now == seen:
                break
            seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
