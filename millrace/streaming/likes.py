"""The like fold over a stream of toggles; beyond the surveyed catalog, which folds in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.likes import liked
from millrace.sources.shared import table
from millrace.sources.versions import Versioned


def liked_stream(toggles: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The likes of a stream of toggles (seq, id, at): write it in complete mode.

    A source that delivers at least once may repeat a toggle, which would flip the like back: repeats of a seq within
    `late` of event time count once. Its state of seqs is bounded by that time, the fold's by the number of ids.
    """
    return liked(toggles.withWatermark("at", late).dropDuplicatesWithinWatermark(["seq"]))


class LikeState(StatefulProcessor):
    """Of one id whether it is liked and since which toggle, and the toggles of late, which may be delivered again.

    Both are sums, of counts and of maxima, so toggles may come in any order.
    """

    def __init__(self, remember_ms: int):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.like = handle.getValueState("like", "n long, seq long")
        self.late = handle.getMapState("late", "seq long", "seen boolean", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.like.get() or (0, -(1 << 63))
        for part in rows:
            for seq in part["seq"].tolist():
                if not self.late.containsKey((seq,)):
                    self.late.updateValue((seq,), (True,))
                    n, last = n ^ 1, max(last, seq)
        self.like.update((n, last))
        yield pd.DataFrame({"id": [key[0]], "liked": [bool(n)], "liked_seq": [last]})

    def close(self) -> None:
        pass


def like_changes(toggles: DataFrame, remember: str = "10 minutes") -> DataFrame:
    """A row (id, liked, liked_seq) for each id that a batch of the stream of toggles (seq, id) names: write it in update mode.

    Repeats of a seq count once if they come within `remember`, of processing time, of its last delivery. State is a row an
    id, kept as long as the query's checkpoint, and the seqs of late, which expire. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). Toggles without id or seq are left out.
    """
    span = int(pd.Timedelta(remember).total_seconds() * 1000)
    known = toggles.select("id", F.col("seq").cast("long").alias("seq")).where("id is not null and seq is not null")
    return known.groupBy("id").transformWithStateInPandas(LikeState(span), "id string, liked boolean, liked_seq long", "update", "processingtime")


def keep(likes: Versioned, changes: DataFrame) -> list[str]:
    """Brings a table of likes (id, liked_seq) up to the state that `changes` (id, liked, liked_seq; an id once) tells; gives the files
    written again. Taken twice the same changes do nothing more, so a batch may be delivered again."""
    changes = table(changes)
    known = table(likes.holding(changes.select(F.col("id").alias("key"))).select(F.col("key").alias("id")).distinct())

    def change(rows: DataFrame) -> DataFrame:
        met = rows.join(changes.select("id", "liked", F.col("liked_seq").alias("last")), "id", "left")
        return met.where("liked is null or liked").select("id", F.coalesce("last", "liked_seq").alias("liked_seq"))

    new = changes.where("liked").join(known, "id", "left_anti").select("id", "liked_seq")
    return likes.rewrite(known.select(F.col("id").alias("key")), change, None if new.isEmpty() else new)


def keep_likes(toggles: DataFrame, likes: Versioned, checkpoint: str, remember: str = "10 minutes", **trigger) -> StreamingQuery:
    """Starts a query that keeps a table of likes up with a stream of toggles; each batch is one commit at most.

    A query whose state expires by the clock always has another batch to look at, so availableNow doesn't end: take once=True for a single run.
    """
    writer = like_changes(toggles, remember).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, _: keep(likes, batch) and None).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
