"""The hand-derived cases of FIXTURES.md, and the queries against their SQL."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import likes, listing, writes
from millrace.plans import catalog_queries
from millrace.sources import products as source
from millrace.sources import shared
from millrace.streaming.likes import liked_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DAY = dt.datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def shelf(spark):
    """Base order: n (no time), a, b, c, d."""
    rows = [(i, f"T{i}", brand, "5", "", cat, None, at, owner) for i, brand, cat, at, owner in [
        ("d", "y", "shoes", DAY, None), ("b", "x", "bags", DAY + dt.timedelta(days=2), "u1"), ("a", "x", "shoes", DAY + dt.timedelta(days=2, microseconds=1), "u2"),
        ("n", "z", "shoes", None, ""), ("c", "y", "", DAY + dt.timedelta(days=1), "u1")]]
    return spark.createDataFrame(rows, source.SCHEMA)


@pytest.fixture(scope="module")
def liked(spark):
    toggles = spark.createDataFrame([(1, "b"), (2, "d"), (3, "zzz"), (4, "c"), (5, "c"), (6, "b"), (7, "b")], "seq long, id string")
    return likes.liked(toggles)


def test_toggles(spark, liked):
    assert sorted(map(tuple, liked.collect())) == [("b", 7), ("d", 2), ("zzz", 3)]
    parity = spark.createDataFrame(list(enumerate("39433")), "seq long, id string")
    assert [r["id"] for r in likes.liked(parity).orderBy(F.desc("liked_seq")).collect()] == ["3", "4", "9"]


def test_feed_order(shelf, liked):
    assert [r["id"] for r in listing.feed(shelf, liked).orderBy("pos").collect()] == ["b", "d", "n", "a", "c"]
    assert [r["id"] for r in listing.feed(shelf, liked.where("id = 'zzz'")).orderBy("pos").collect()] == ["n", "a", "b", "c", "d"]


def test_first_seen(shelf):
    assert [r["category"] for r in listing.categories(shelf).orderBy("pos").collect()] == ["shoes", "bags", ""]
    assert [r["brand"] for r in listing.brands(shelf).orderBy("pos").collect()] == ["z", "x", "y"]
    assert [r["brand"] for r in listing.brands(shelf, "").collect()] == ["y"]


def test_optional_filters(shelf):
    ids = lambda *a: sorted(r["id"] for r in listing.products_by(shelf, *a).collect())
    assert ids("", None) == ["a", "b", "c", "d", "n"] and ids("Shoes") == [] and ids("shoes", "x") == ["a"] and ids(None, "y") == ["c", "d"]


def test_filters_reach_the_scan(spark, shelf, tmp_path):
    source.append(shelf, f"{tmp_path}/p")
    plan = listing.products_by(source.read_products(spark, f"{tmp_path}/p"), "shoes", "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,shoes)" in plan and "owner_id" not in plan.split("ReadSchema")[1]


def test_lookup(shelf, liked):
    assert listing.lookup(shelf.withColumn("id", F.when(F.col("id") == "a", "7").otherwise("x")), 7).count() == 1
    assert listing.lookup(shelf, "none").isEmpty()
    row = listing.detail(shelf, liked, "c").first()
    assert (row["image"], row["category"], row["price"], row["link"], row["liked"]) == ("No Image", None, "5", "No Link", False)


@pytest.mark.parametrize(("owner", "user", "same"), [(None, None, True), ("", None, True), ("a", None, False), ("a", "a", True), ("a", "b", False)])
def test_ownership(spark, owner, user, same):
    assert value(spark, text.owned_by(F.lit(owner).cast("string"), user)) is same
    assert value(spark, text.owned_by(F.lit(owner).cast("string"), user, strict=True)) is (same and bool(owner))


@pytest.mark.parametrize(("uri", "ext"), [("X/a.JPG?v=1", "jpg"), ("a.jpg?v=1.2", "2"), ("nodot", "nodot"), ("p.jpeg", "jpg")])
def test_extensions(spark, uri, ext):
    assert value(spark, text.file_ext(F.lit(uri))) == ext


def test_text_functions(spark):
    assert value(spark, text.uri_component(F.lit("A b!~*'()&/é+%"))) == "A%20b!~*'()%26%2F%C3%A9%2B%25"
    assert [value(spark, text.mime_type(F.lit(x))) for x in ("jpg", "png")] == ["image/jpeg", "image/png"]
    assert [value(spark, text.link_label(F.lit(x).cast("string"))) for x in ("", None, "x")] == ["No Link", "No Link", "Open Link"]
    assert [value(spark, text.blank_to_null(F.lit(x))) for x in ("  ", " abc ", "")] == [None, "abc", None]
    spaces = "\t\n\x0b\f\r \u00a0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    assert value(spark, text.trimmed(F.lit(f"{spaces}a b{spaces}"))) == "a b"
    assert value(spark, text.trimmed(F.lit("\u200ba\u0085"))) == "\u200ba\u0085"
    assert value(spark, text.listing_title(F.lit(""), F.lit("bags"))) == "Products · BAGS"
    assert value(spark, text.public_url("http://s/", F.lit(None).cast("string"))) == ""
    assert value(spark, text.product_route(F.lit("a b"))) == "/a%20b"


def test_drafts(spark):
    schema = "image_uri string, title string, brand string, price string, category string, url string, user_id string"
    rows = [(None, " ", "b", "1", "c", "u", None), ("i", "\t ", "b", "1", "c", "u", "u"), ("i", "t", "b", "1", "c", "u", None), ("i", " t ", "b", " ", "c", " ", "u"), ("i", None, "b", "1", "c", "u", "u")]
    drafts = spark.createDataFrame(rows, schema)
    assert [r["reject_reason"] for r in writes.validated(drafts).collect()] == ["image", "fields", "user", None, "fields"]
    assert [tuple(r) for r in writes.normalised(drafts, "http://s/", F.lit(5)).collect()] == [("t", "b", None, "c", None, "http://s/products/5.i", "u")]
    assert writes.normalised(drafts, "http://s/").first()["image_url"].startswith("http://s/products/")


def test_clock(spark):
    assert abs(value(spark, text.now_millis()) / 1000 - time.time()) < 300


def test_update(spark, shelf):
    patches = spark.createDataFrame([("a", " New ", "x", " ", "bags", " u "), ("b", " ", "x", "1", "bags", "u"), ("none", "t", "b", "1", "c", "u")], "id string, title string, brand string, price string, category string, url string")
    rows = {r["id"]: r for r in writes.updated(shelf, patches).collect()}
    old = {r["id"]: r for r in shelf.collect()}
    assert (rows["a"]["title"], rows["a"]["price"], rows["a"]["url"], rows["a"]["category"]) == ("New", None, "u", "bags")
    assert rows["b"] == old["b"] and len(rows) == 5
    assert all(rows["a"][c] == old["a"][c] for c in ("image_url", "owner_id", "created_at"))
    assert {r["title"] for r in writes.updated(shelf, patches, "u1", check_owner=True).collect()} == {r["title"] for r in old.values()}


def test_refused_updates(spark, shelf):
    patches = spark.createDataFrame([("a", "t", "x", "1", "bags", ""), ("b", " ", "x", "1", "bags", "u"), ("none", "t", "b", "1", "c", "u"), ("c", "t", "b", "1", "c", "u")], "id string, title string, brand string, price string, category string, url string")
    assert sorted(map(tuple, writes.refused(shelf, patches, "u1").collect())) == [("a", "owner"), ("b", "fields"), ("none", "product")]
    changed = writes.updated(shelf, patches, "u1", check_owner=True).where("title = 't'")
    assert [r["id"] for r in changed.collect()] == ["c"]


def test_several_patches_of_an_id(spark, shelf):
    patches = spark.createDataFrame([(2, "a", "late", "x", "1", "bags", ""), (1, "a", "soon", "x", "1", "bags", "")], "seq int, id string, title string, brand string, price string, category string, url string")
    rows = {r["id"]: r["title"] for r in writes.updated(shelf, patches).collect()}
    assert len(rows) == writes.updated(shelf, patches).count() == 5 and rows["a"] == "late"
    assert {r["title"] for r in writes.updated(shelf, patches.drop("seq")).where("id = 'a'").collect()} == {"soon"}


def test_empty_listing(shelf):
    assert [r["message"] for r in listing.if_empty(listing.products_by(shelf, "hats"), listing.NO_PRODUCTS).collect()] == [listing.NO_PRODUCTS]
    assert listing.if_empty(shelf, listing.NO_BRANDS).isEmpty()


def test_insert_comes_first(spark, shelf):
    new = shelf.limit(1).withColumn("id", F.lit("new"))
    assert [r["id"] for r in writes.prepended(shelf, new).orderBy("pos").collect()] == ["new", "n", "a", "b", "c", "d"]


def test_positions_over_many_tasks(spark):
    rows = spark.range(5000).withColumn("k", F.xxhash64("id"))
    got = listing.positions(rows.repartition(7), F.col("k")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(5000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_refresh_keeps_rows_on_error(spark, shelf, tmp_path):
    path = f"{tmp_path}/products"
    table = source.Products(spark, path)
    assert table.rows.isEmpty() and table.rows.columns == source.COLUMNS and table.error
    source.append(shelf, path)
    assert table.refresh().count() == 5 and table.error is None
    shutil.move(path, f"{tmp_path}/away")
    assert table.refresh().count() == 5 and table.error
    assert sorted(r["id"] for r in table.rows.collect()) == ["a", "b", "c", "d", "n"]


def test_products_are_read_at_the_start_and_lists_made_once(spark, shelf, tmp_path):
    path = f"{tmp_path}/products"
    source.append(shelf, path)
    table = source.Products(spark, path)
    assert table.rows.count() == 5 and table.error is None
    made = []
    build = lambda p: made.append(1) or listing.products_by(p, "shoes")
    assert table.made(("shoes", None), build) is table.made(("shoes", None), build) and len(made) == 1
    row = table.add({"title": "t", "brand": "b", "category": "shoes", "price": None, "url": None, "id": "mine", "owner_id": "me"}, DAY).first()
    assert (row["title"], row["image_url"], row["owner_id"], row["created_at"]) == ("t", None, None, DAY) and row["id"] not in ("mine", None)
    assert table.made(("shoes", None), build).count() == 4 and len(made) == 2
    assert table.refresh().count() == 6


def test_configuration_is_asked_for_at_once():
    assert source.products_path({"MILLRACE_PRODUCTS": "/p"}) == "/p"
    with pytest.raises(RuntimeError, match="MILLRACE_PRODUCTS"):
        source.products_path({})
    assert [source.said(e) for e in (ValueError("why"), ValueError())] == ["why", "Something went wrong."]


@pytest.mark.parametrize("kind", ["files", "filtered files", "csv", "shuffled", "repeated"])
def test_numbers_stay_when_the_cores_change(spark, kind, tmp_path):
    spark.range(3000).repartition(7).withColumns({"row": F.lit(1), "text": F.sha2(F.col("id").cast("string"), 512)}).write.format("csv" if kind == "csv" else "parquet").save(f"{tmp_path}/t x")
    docs = spark.read.schema("id long, row int, text string").format("csv" if kind == "csv" else "parquet").load(f"{tmp_path}/t x")
    docs = {"filtered files": docs.where("id % 2 = 0").select("id", "row"), "shuffled": docs.repartition(5, "id"), "repeated": docs.union(docs)}.get(kind, docs)
    rows, name = shared.numbered(docs)
    assert rows.columns == [*docs.columns, "row_"] and name == "row_"
    first = sorted((r["id"], r[name]) for r in rows.collect())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert sorted((r["id"], r[name]) for r in rows.collect()) == first and len({n for _, n in first}) == len(first) == docs.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_tables_are_freed(spark, monkeypatch):
    monkeypatch.setattr(shared, "_held", [])
    rows = shared.table(spark.range(5))
    files = [f.removeprefix("file://") for f in rows.inputFiles()]
    assert files and all(map(os.path.exists, files)) and shared.free(spark) == 1
    assert not any(map(os.path.exists, files)) and shared.free(spark) == 0


@pytest.mark.parametrize("scan", [True, False])
def test_numbers_beside_any_column(spark, scan, tmp_path):
    names = ["_n", "_N_", "row", "row_", "rowfile", "rowplace", "rowcount", "row_count", "a.b", "_metadata" if not scan else "m"]
    docs = spark.range(9).select(*[F.col("id").alias(c) for c in names])
    if scan:
        docs.write.parquet(f"{tmp_path}/t")
        docs = spark.read.parquet(f"{tmp_path}/t")
    rows, name = shared.numbered(docs)
    assert rows.columns == [*names, name] and name == "row__" and rows.select(name).distinct().count() == 9
    assert sorted(map(tuple, rows.drop(name).collect())) == [(i,) * len(names) for i in range(9)]


def test_single_and_schema(shelf):
    assert source.single(shelf.where("id = 'a'")).count() == 1
    for wrong in (shelf, shelf.where("false")):
        with pytest.raises(ValueError, match="exactly one"):
            source.single(wrong)
    with pytest.raises(ValueError, match="price"):
        source.checked(shelf.withColumn("price", F.lit(1)))


def test_streamed_likes(spark, small, tmp_path):
    """A redelivered toggle counts once."""
    toggles = catalog_queries.toggles(spark, small).withColumn("at", F.timestamp_millis(F.lit(0) + F.col("seq")))
    toggles.union(toggles.where("seq % 3 = 0")).repartition(3).write.parquet(f"{tmp_path}/t")
    stream = liked_stream(spark.readStream.schema(toggles.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t"))
    stream.writeStream.format("memory").queryName("likes_now").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("likes_now").collect())) == sorted(map(tuple, likes.liked(toggles).collect()))


def test_buckets_spare_a_shuffle(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = shared.bucketed(spark.range(1000).withColumn("text", F.lit("x")), "id", 5)
        both = left.join(spark.range(0, 1000, 3), "id", "left_semi")
        assert both.count() == 334 and both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = catalog_queries.queries()[name](spark, small)
    found = con.execute(catalog_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in found.fetchall()) == sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
