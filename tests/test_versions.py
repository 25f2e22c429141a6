"""Versioned tables: snapshots, rewriting by file, unique keys; and what is kept up to date from changes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import likes, listing, maintained, writes
from millrace.sources import products as source
from millrace.sources import versions as v
from millrace.sources.objects import Objects, read_images
from millrace.sources.shelves import Shelves, lay_out
from millrace.sources.store import Store

DAY = dt.datetime(2024, 1, 1)


def shelf(spark, n, first=0, pages=1):
    at = F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 60).cast("timestamp_ntz")
    text = lambda s: F.concat(F.lit(s), (F.col("id") % 3).cast("string"))
    rows = spark.range(first, first + n, 1, pages).select(F.format_string("p%04d", "id").alias("id"), F.lit("t").alias("title"), text("b").alias("brand"), F.lit("5").alias("price"), F.lit(None).cast("string").alias("url"), text("c").alias("category"), F.lit(None).cast("string").alias("image_url"), at.alias("created_at"), F.lit("u1").alias("owner_id"))
    return rows.select(*source.COLUMNS)


@pytest.fixture
def table(spark, tmp_path):
    found = v.Versioned(spark, f"{tmp_path}/t", source.SCHEMA, "id")
    assert found.append(shelf(spark, 100, pages=100).repartitionByRange(100, "id")).isEmpty()
    return found


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def written(spark, path):
    """Files of rows in a folder, old and new."""
    return {x for c in Store(spark, path).names("data") for x in Store(spark, path).names(f"data/{c}")}


def test_patching_one_id_rewrites_one_file(spark, table):
    before = table.version().files
    assert len(before) > 20
    patches = spark.createDataFrame([("p0042", " New ", "b", "1", "c", ""), ("none", "t", "b", "1", "c", ""), ("p0007", " ", "b", "1", "c", "")], "id string, title string, brand string, price string, category string, url string")
    gone = writes.patch_files(table, patches)
    after = table.version().files
    assert len(gone) == 1 and len(set(after) - set(before)) == 1 and set(before) - set(after) == set(gone)
    wanted = writes.updated(shelf(spark, 100), patches)
    assert sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, wanted.collect()))
    assert writes.patch_files(table, patches.where("id = 'none'")) == [] and table.version().files == after


def test_refresh_copies_nothing_and_frees_what_was(spark, table, tmp_path, monkeypatch):
    shown = source.Products(spark, table.path)
    files = written(spark, table.path)
    assert shown.rows.count() == 100 and shown.refresh().count() == 100 and written(spark, table.path) == files
    assert set(shown.rows.inputFiles()) == {table.store.url(f) for f in table.version().files}
    old = shown.rows
    table.append(shelf(spark, 5, 100))
    writes.patch_files(table, spark.createDataFrame([("p0001", "New", "b", "1", "c", "")], "id string, title string, brand string, price string, category string, url string"))
    assert table.free() == [2] and old.where("title = 'New'").isEmpty() and old.count() == 100
    with monkeypatch.context() as m:
        m.setattr(v.Versioned, "version", lambda *_: (_ for _ in ()).throw(OSError("store is away")))
        assert shown.refresh() is old and shown.error == "store is away" and old.count() == 100
    assert shown.refresh().count() == 105 and shown.error is None
    assert shown.refresh().where("title = 'New'").count() == 1
    assert table.numbers() == [3] and len(written(spark, table.path)) == len(table.version().files)


def test_products_are_added_to_versions(spark, table):
    shown = source.Products(spark, table.path)
    for name in ("x", "y"):
        shown.add({"title": name, "brand": "b", "category": "c"}, DAY)
    assert shown.rows.count() == 102 and shown.rows._jdf.queryExecution().analyzed().toString().count("Union") == 1
    assert shown.refresh().where("title in ('x', 'y')").count() == 2


def test_repeated_ids_are_refused(spark, table):
    files = len(table.version().files)
    new = shelf(spark, 4, 98).unionByName(shelf(spark, 1, 101)).unionByName(shelf(spark, 1).withColumn("id", F.lit(None).cast("string")))
    assert sorted(map(tuple, table.append(new).collect()), key=str) == [("p0098", "stored"), ("p0099", "stored"), ("p0101", "twice"), (None, "missing")]
    assert ids(table.rows()) == [f"p{i:04}" for i in range(101)] and len(table.version().files) > files
    assert table.append(new.where("id = 'p0101'").limit(1)).isEmpty() and table.rows().count() == 102


def test_the_stored_table_is_not_shuffled(spark, table, monkeypatch):
    """New ids meet the filters and then the key column of single files."""
    opened = []
    keys = v.Versioned._keys
    monkeypatch.setattr(v.Versioned, "_keys", lambda self, files: opened.append(files) or keys(self, files))
    found = table.holding(spark.createDataFrame([("p0003",), ("new",)], "key string"))
    assert [r["key"] for r in found.collect()] == ["p0003"] and [len(f) for f in opened] == [1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan and "title" not in plan
    scan = plan[plan.index("BroadcastHashJoin") :]
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in scan.split("BroadcastExchange")[0]


def test_filters_miss_nothing(spark, tmp_path):
    """Of many keys all are found; of as many others hardly any."""
    found = v.Versioned(spark, f"{tmp_path}/t", "id string", "id")
    found.append(spark.range(0, 40_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("id")))
    filters = found.filters(found.version())
    assert filters.select("blocks").distinct().count() >= 1 and filters.agg(F.max("blocks")).first()[0] > 4
    asked = spark.range(0, 80_000, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    met = v.may_hold(filters, asked)
    stored = found.rows().select(F.col("id").alias("key"))
    assert met.join(stored, "key", "left_semi").select("key").distinct().count() == 40_000
    assert met.count() - 40_000 < 40


def test_filters_go_with_their_files(spark, tmp_path):
    found = v.Versioned(spark, f"{tmp_path}/t", "id string, n long", "id")
    found.append(spark.createDataFrame([("a", 1), ("b", 1)], "id string, n long").coalesce(1))
    found.append(spark.createDataFrame([("c", 1)], "id string, n long").coalesce(1))
    for _ in range(3):
        found.rewrite(spark.createDataFrame([("a",)], "key string"), lambda rows: rows.withColumn("n", F.col("n") + 1))
    assert len(found.version().filters) == len(found.version().files) == 2
    assert found.free() == [1, 2, 3, 4] and len(found.store.names("keys")) == 2
    assert sorted(map(tuple, found.rows().collect())) == [("a", 4), ("b", 4), ("c", 1)]
    assert [tuple(r) for r in found.append(spark.createDataFrame([("b", 9)], "id string, n long")).collect()] == [("b", "stored")]


def test_two_writers(spark, table, monkeypatch):
    """A commit that comes in between: keys it stored are refused, files it replaced are looked for again."""
    commit, first = v.Versioned._commit, []

    def late(self, base, files, filters):
        if not first:
            first.append(1)
            assert v.Versioned(spark, table.path, source.SCHEMA, "id").append(shelf(spark, 1, 200)).isEmpty()
        return commit(self, base, files, filters)

    monkeypatch.setattr(v.Versioned, "_commit", late)
    assert [tuple(r) for r in table.append(shelf(spark, 2, 200)).collect()] == [("p0200", "stored")]
    assert ids(table.rows()) == [*(f"p{i:04}" for i in range(100)), "p0200", "p0201"]
    first.clear()

    def change(rows):
        return rows.withColumn("title", F.concat("title", F.when(F.col("id") == "p0005", "+").otherwise("")))

    def late(self, base, files, filters):
        if not first:
            first.append(1)
            v.Versioned(spark, table.path, source.SCHEMA, "id").rewrite(spark.createDataFrame([("p0005",)], "key string"), change)
        return commit(self, base, files, filters)

    monkeypatch.setattr(v.Versioned, "_commit", late)
    table.rewrite(spark.createDataFrame([("p0005",)], "key string"), change)
    assert table.rows().where("id = 'p0005'").first()["title"] == "t++" and table.rows().count() == 102


def test_a_name_is_taken_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.put_new("a/x", "één") and not store.put_new("a/x", "two") and store.read("a/x") == "één"
    assert store.names("a") == ["x"] and store.names("b") == [] and store.names("") == ["a"]


def test_an_empty_table(spark, tmp_path):
    found = v.Versioned(spark, f"{tmp_path}/t", source.SCHEMA, "id")
    assert found.rows().columns == source.COLUMNS and found.rows().isEmpty() and found.numbers() == [] and found.free() == []
    assert found.pin() == v.Version(0) and found.append(shelf(spark, 0)).isEmpty() and found.rows().isEmpty()
    assert found.rewrite(spark.createDataFrame([("x",)], "key string"), lambda rows: rows) == []


def test_drafts_of_one_job_have_images_of_their_own(spark):
    drafts = spark.range(0, 50, 1, 4).select(F.lit("f.png").alias("image_uri"), F.lit("t").alias("title"), F.lit("b").alias("brand"), F.lit("1").alias("price"), F.lit("c").alias("category"), F.lit("").alias("url"), F.lit("u").alias("user_id"))
    assert writes.normalised(drafts, "s/").select("image_url").distinct().count() == 50


def test_a_random_history_is_as_a_rebuild(spark, tmp_path):
    """Inserts, patches and toggles, some of ids that come later or never: the feed, its likes and first-seen listings."""
    rng = random.Random(3)
    feed = maintained.Feed(spark, f"{tmp_path}/feed")
    products, toggles, seq = shelf(spark, 40), [], 0
    schema = "seq long, id string"

    def some_toggles():
        nonlocal seq
        found = []
        for _ in range(rng.randint(1, 8)):
            seq += 1
            found.append((seq, f"p{rng.choice([1, 2, 3, rng.randrange(60)]):04}"))
        toggles.extend(found)
        return spark.createDataFrame(found, schema)

    feed.build(products, some_toggles(), 8)
    brands = listing.firsts(products, "brand")
    for step in range(5):
        feed.toggle(some_toggles())
        if step % 2:
            new = shelf(spark, 3, 40 + 3 * step)
            assert feed.insert(new).isEmpty()
            before, after = new.where("false"), new
        else:
            chosen = rng.sample(range(40), 3)
            patches = spark.createDataFrame([(f"p{i:04}", "n", rng.choice(["b0", "bx"]), "", "c9", "") for i in chosen], "id string, title string, brand string, price string, category string, url string")
            feed.patch(patches)
            before = products.join(patches.select("id"), "id", "left_semi")
            after = writes.updated(before, patches)
        products = spark.createDataFrame(products.join(before.select("id"), "id", "left_anti").select(*source.COLUMNS).collect() + after.collect(), source.SCHEMA)
        brands = maintained.firsts_after(brands, "brand", before, after, products)
        rebuilt = likes.liked(spark.createDataFrame(toggles, schema))
        assert sorted(map(tuple, feed.likes.rows().collect())) == sorted(map(tuple, rebuilt.collect()))
        assert sorted(map(tuple, feed.cards().collect())) == sorted(map(tuple, listing.feed(products, rebuilt).collect()))
        assert sorted(map(tuple, brands.collect())) == sorted(map(tuple, listing.firsts(products, "brand").collect()))


def test_one_toggle_touches_one_page(spark, tmp_path):
    feed = maintained.Feed(spark, f"{tmp_path}/feed")
    feed.build(shelf(spark, 40), spark.createDataFrame([(1, "p0001")], "seq long, id string"), 8)
    pages = feed.held.version().files
    assert len(pages) == 8 and len(feed.toggle(spark.createDataFrame([(2, "p0030"), (3, "p0002"), (4, "p0002")], "seq long, id string"))) == 1
    assert len(set(pages) & set(feed.held.version().files)) == 7
    assert ids(feed.held.rows().where("liked")) == ["p0001", "p0030"]


def files_read(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numFiles").get().value()


def test_a_listing_reads_one_shelf(spark, small, tmp_path):
    products = source.from_tables(spark, small).unionByName(shelf(spark, 9).withColumn("category", F.when(F.col("id") != "p0003", "")))
    lay_out(products, f"{tmp_path}/s", 16, 40)
    held = Shelves(spark, f"{tmp_path}/s")
    for asked in (("PROMO", "Brand#13"), ("PROMO", None), ("", "b1"), (None, None), ("none", None)):
        assert sorted(map(tuple, held.products_by(*asked).collect())) == sorted(map(tuple, listing.products_by(products, *asked).collect()))
    for category in ("PROMO", "", None):
        assert sorted(map(tuple, held.brands(category).collect())) == sorted(map(tuple, listing.brands(products, category).collect()))
    every = files_read(held.products_by())
    assert 0 < files_read(held.products_by("PROMO", "Brand#13")) <= every / 3
    plan = held.products_by("PROMO", "Brand#13")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan and "EqualTo(brand,Brand#13)" in plan


def test_objects_are_never_overwritten(spark, tmp_path):
    held = Objects(spark, f"{tmp_path}/o")
    schema = "source long, path string, content binary"
    rows = [(1, "a.jpeg", b"one"), (2, "a.jpeg", b"two"), (3, "b.png", b"x"), (4, None, b"y")]
    assert sorted(map(tuple, held.put(spark.createDataFrame(rows, schema).repartition(4)).collect())) == [(2, "a.jpeg", "taken"), (4, None, "missing")]
    again = spark.createDataFrame([(5, "a.jpeg", b"five"), (6, "c.jpg", b"six")], schema)
    assert [tuple(r) for r in held.put(again).collect()] == [(5, "a.jpeg", "taken")]
    assert sorted((r["path"], r["mime"], bytes(r["content"])) for r in held.rows().collect()) == [("a.jpeg", "image/jpeg", b"one"), ("b.png", "image/png", b"x"), ("c.jpg", "image/jpeg", b"six")]
    assert held.get("b.png").count() == 1 and "EqualTo(path,b.png)" in held.get("b.png")._jdf.queryExecution().executedPlan().toString()


def test_uploads_from_image_files(spark, tmp_path):
    """Image files to objects and products; the largest file is not opened."""
    (tmp_path / "i" / "more").mkdir(parents=True)
    for name, data in (("a.JPEG", b"\xff\x00a"), ("more/b.png", b"b"), ("big.png", b"x" * 5000)):
        (tmp_path / "i" / name).write_bytes(data)
    images = read_images(spark, f"{tmp_path}/i", most=4000)
    uri = lambda name: f"file:{tmp_path}/i/{name}"
    rows = [(1, uri("a.JPEG"), " t ", "u"), (2, uri("more/b.png"), "t", "u"), (3, uri("big.png"), "t", "u"), (4, None, "t", "u"), (5, uri("a.JPEG"), " ", "u"), (6, uri("a.JPEG"), "t", None)]
    drafts = spark.createDataFrame([(i, image, title, "b", "1", "c", "", user) for i, image, title, user in rows], "draft_id long, image_uri string, title string, brand string, price string, category string, url string, user_id string")
    objects, products = Objects(spark, f"{tmp_path}/o"), v.Versioned(spark, f"{tmp_path}/p", source.SCHEMA, "id")
    now = F.timestamp_millis(F.lit(1_700_000_000_000))
    asked = writes.upload(drafts, images, objects, products, "https://s/", now)
    assert sorted(map(tuple, asked.collect())) == [(3, "unread"), (4, "image"), (5, "fields"), (6, "user")]
    assert sorted((r["title"], r["image_url"], r["owner_id"]) for r in products.rows().collect()) == [("t", "https://s/products/1700000000000-1.jpg", "u"), ("t", "https://s/products/1700000000000-2.png", "u")]
    assert {r["path"]: bytes(r["content"]) for r in objects.rows().collect()} == {"products/1700000000000-1.jpg": b"\xff\x00a", "products/1700000000000-2.png": b"b"}
    again = writes.upload(drafts.where("draft_id < 3"), images, objects, products, "https://s/", now)
    assert sorted(map(tuple, again.collect())) == [(1, "taken"), (2, "taken")] and products.rows().count() == 2
