"""Likes as keyed state: one row a toggled id, out-of-order and repeated toggles, restarts, and the table that follows."""

from __future__ import annotations

import random

import pytest

from millrace.operators import likes
from millrace.plans import catalog_queries
from millrace.sources.versions import Versioned
from millrace.streaming.likes import keep, keep_likes, like_changes

SCHEMA = "seq long, id string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


@pytest.fixture
def source(spark, tmp_path):
    """A stream of files, and how to add one."""

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return add, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(spark, stream, tmp_path, batches):
    """Takes what is there and adds each batch's rows to `batches`."""

    def see(batch, number):
        batches.append(sorted(map(tuple, batch.collect())))

    query = like_changes(stream()).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint")
    query.foreachBatch(see).trigger(once=True).start().awaitTermination(60)


def test_a_toggle_gives_one_row_and_state_outlives_a_restart(spark, source, tmp_path):
    add, stream = source
    batches = []
    add([(5, "a"), (1, "b"), (2, "b"), (3, "b"), (9, None)])
    run(spark, stream, tmp_path, batches)
    assert batches == [[("a", True, 5), ("b", True, 3)]]
    # after a restart: an older toggle that comes late, one that was delivered before, and a new id
    add([(4, "a"), (3, "b"), (7, "c")])
    run(spark, stream, tmp_path, batches)
    assert batches[1:] == [[("a", False, 5), ("b", True, 3), ("c", True, 7)]]
    add([(8, "a")])
    run(spark, stream, tmp_path, batches)
    assert batches[2:] == [[("a", True, 8)]]


def test_the_table_follows_the_stream(spark, source, small, tmp_path):
    """All toggles of the events table, in disorder, a third of them twice, in three batches."""
    rows = [tuple(r) for r in catalog_queries.toggles(spark, small).collect()]
    sent = rows + rows[::3]
    random.Random(2).shuffle(sent)
    add, stream = source
    held = Versioned(spark, f"{tmp_path}/likes", "id string, liked_seq long", "id")
    for i in range(3):
        add(sent[i::3])
        keep_likes(stream(), held, f"{tmp_path}/c", once=True).awaitTermination(60)
    wanted = likes.liked(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, held.rows().collect())) == sorted(map(tuple, wanted.collect()))
    assert 1 <= len(held.numbers()) <= 3


def test_a_batch_taken_twice(spark, tmp_path):
    held = Versioned(spark, f"{tmp_path}/likes", "id string, liked_seq long", "id")
    schema = "id string, liked boolean, liked_seq long"
    for rows in ([("a", True, 1), ("b", False, 2)], [("a", False, 3), ("c", True, 4)]):
        changes = spark.createDataFrame(rows, schema)
        keep(held, changes)
        before = sorted(map(tuple, held.rows().collect()))
        keep(held, changes)
        assert sorted(map(tuple, held.rows().collect())) == before
    assert before == [("c", 4)]
