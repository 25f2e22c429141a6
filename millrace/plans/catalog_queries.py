"""The registered catalog queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import likes, listing, maintained, writes
from millrace.plans.catalog_sql import ORACLES
from millrace.sources.objects import Objects
from millrace.sources.products import SCHEMA, from_tables
from millrace.sources.shared import new_path
from millrace.sources.shelves import Shelves, lay_out
from millrace.sources.versions import Versioned

NOW = 1_700_000_000_000


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    return events.select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("id"))


def liked_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likes.liked(toggles(spark, sf_dir))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.feed(from_tables(spark, sf_dir), liked_set(spark, sf_dir))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.categories(from_tables(spark, sf_dir))


def brands_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.brands(from_tables(spark, sf_dir), "PROMO")


def products_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.products_by(from_tables(spark, sf_dir), "PROMO", "Brand#13")


def products_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.products_by(from_tables(spark, sf_dir), "PROMO")


def products_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.products_by(from_tables(spark, sf_dir), "", "Brand#13")


def products_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.products_by(from_tables(spark, sf_dir), "", None)


def product_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.detail(from_tables(spark, sf_dir), liked_set(spark, sf_dir), 7)


def product_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.details(listing.marked(from_tables(spark, sf_dir), liked_set(spark, sf_dir)))


def owner_editable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, owner = from_tables(spark, sf_dir), F.col("owner_id")
    return p.select("id", text.owned_by(owner, "1").alias("by_user"), text.owned_by(owner, None).alias("by_nobody"), text.owned_by(owner, None, strict=True).alias("strict"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made up over part so that every reason and every blank occurs."""
    k, nbsp = F.col("p_partkey"), F.lit("\u00a0")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("p_partkey"), F.col("url").alias("page"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").join(pages, "p_partkey", "left")
    return part.select(
        k.alias("draft_id"),
        F.when(k % 13 != 0, F.format_string("file:///i/%d.jpeg", k)).alias("image_uri"),
        F.when(k % 7 == 0, F.concat(F.lit("\t "), nbsp)).otherwise(F.concat(F.lit("  "), "p_name", F.lit("\t\n"))).alias("title"),
        F.concat(nbsp, "p_brand", F.lit(" ")).alias("brand"),
        F.when(k % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit("\n"))).alias("price"),
        F.when(k % 11 == 0, "").otherwise(F.col("p_type")).alias("category"),
        F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit(" "), "page", F.lit(" "))).alias("url"),
        F.when(k % 17 != 0, "u1").alias("user_id"),
    )


def normalize_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_drafts(drafts(spark, sf_dir))


def stored_drafts(found: DataFrame) -> DataFrame:
    return writes.normalised(found, "https://store/", F.lit(NOW) + F.col("draft_id"))


def rejected_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.rejected(drafts(spark, sf_dir)).select("draft_id", "reject_reason")


def patches_of(p: DataFrame) -> DataFrame:
    """Patches to every fifth product, in part without a title."""
    n = F.col("id").cast("long")
    url = F.when(n % 2 == 0, "").otherwise(" http://n ")
    title = F.when(n % 35 == 0, " ").otherwise(F.concat(F.lit(" "), "title", F.lit(" v2 ")))
    return p.where(n % 5 == 0).select("id", title.alias("title"), "brand", "category", F.lit("  ").alias("price"), url.alias("url"))


def apply_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_tables(spark, sf_dir)
    return writes.updated(p, patches_of(p))


def owner_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_tables(spark, sf_dir)
    return writes.updated(p, patches_of(p), "1", check_owner=True)


def refused_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_tables(spark, sf_dir)
    unknown = patches_of(p).withColumn("id", F.concat(F.lit("x"), "id"))
    return writes.refused(p, patches_of(p).unionByName(unknown), "1")


def added_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = from_tables(spark, sf_dir).select(F.concat(F.lit("n"), "id").alias("id"), "title", "brand", "price", "url", "category")
    return writes.added(inputs, F.timestamp_millis(F.lit(NOW)))


def empty_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_tables(spark, sf_dir)
    asked = [("both", listing.products_by(p, "PROMO", "Brand#13"), listing.NO_PRODUCTS), ("nobody", listing.products_by(p, "PROMO", "nobody"), listing.NO_PRODUCTS)]
    asked += [("shoes", p.where("category = 'shoes'").select("brand"), listing.NO_BRANDS), ("PROMO", p.where("category = 'PROMO'").select("brand"), listing.NO_BRANDS)]
    return reduce(DataFrame.unionByName, [listing.if_empty(rows, m).select(F.lit(name).alias("asked"), "message") for name, rows, m in asked])


def apply_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = stored_drafts(drafts(spark, sf_dir)).withColumns({"id": F.concat(F.lit("n"), F.col("draft_id").cast("string")), "created_at": F.lit(None).cast("timestamp_ntz")})
    return writes.prepended(from_tables(spark, sf_dir), new).select("pos", "id", "title", "owner_id")


def image_path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = text.file_ext(F.col("url"))
    path = text.object_path(ext, F.lit(NOW))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ext.alias("ext"), text.mime_type(ext).alias("mime"), path.alias("path"), text.public_url("https://store/", path).alias("public_url"))


def brand_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_tables(spark, sf_dir)
    return p.select("id", text.brand_route(F.col("category"), F.col("brand")).alias("route"), text.category_route(F.col("category")).alias("category_route"), text.product_route(F.col("id")).alias("product_route"), text.uri_component(F.col("url")).alias("encoded"))


def listing_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = from_tables(spark, sf_dir).select("brand", "category").distinct()
    none = F.lit("")
    return pairs.select("brand", "category", *[text.listing_title(b, c).alias(n) for n, b, c in (("both", F.col("brand"), F.col("category")), ("no_brand", none, F.col("category")), ("no_category", F.col("brand"), none))])


def edit_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.edit_form(from_tables(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> Versioned:
    """The products as a Versioned table of one commit, in the shared folder."""
    found = Versioned(spark, new_path(spark, "products"), SCHEMA, "id")
    found.append(from_tables(spark, sf_dir))
    return found


def pinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's snapshot, by the files that it pinned, after more rows and patches and after old versions are freed."""
    held = stored(spark, sf_dir)
    first = held.pin()
    held.append(added_products(spark, sf_dir))
    writes.patch_files(held, patches_of(from_tables(spark, sf_dir)))
    held.free()
    return held.rows(first)


def patched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """apply_update, file by file."""
    held = stored(spark, sf_dir)
    writes.patch_files(held, patches_of(from_tables(spark, sf_dir)))
    return held.rows()


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of products that come in again under another id, in part a stored one and in part one for two of them, what is refused."""
    n = F.col("id").cast("long")
    name = F.when(n % 3 == 0, F.col("id")).when(n % 3 == 1, F.concat(F.lit("n"), F.col("id"))).otherwise(F.concat(F.lit("t"), F.floor(n / 6).cast("string")))
    held, p = stored(spark, sf_dir), from_tables(spark, sf_dir)
    return held.append(p.withColumn("id", F.when(n % 50 != 0, name)))


def feed_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed built with a half of the toggles and kept up with the other half."""
    found = maintained.Feed(spark, new_path(spark, "feed"))
    all_toggles = toggles(spark, sf_dir)
    middle = all_toggles.agg(F.percentile_approx("seq", 0.5)).first()[0]
    found.build(from_tables(spark, sf_dir), all_toggles.where(F.col("seq") <= middle))
    found.toggle(all_toggles.where(F.col("seq") > middle))
    return found.cards()


def brands_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen brands, built before patches that rename brands and rows that come first, and brought up to date."""
    p = from_tables(spark, sf_dir)
    before = p.where(F.col("id").cast("long") % 7 == 0)
    after = before.withColumn("brand", F.concat("brand", F.lit("x"))).unionByName(added_products(spark, sf_dir).where(F.col("id").endswith("3")))
    now = p.where(F.col("id").cast("long") % 7 != 0).unionByName(after)
    return listing.in_order_seen(maintained.firsts_after(listing.firsts(p, "brand"), "brand", before, after, now))


def not_found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks on ids, and what the pages of those that no product has say."""
    clicked = toggles(spark, sf_dir).select(F.col("id").alias("key")).distinct()
    keys = clicked.unionByName(clicked.select(F.concat(F.lit("0"), "key").alias("key")))
    p = from_tables(spark, sf_dir).where("category <> 'PROMO'")
    return listing.not_found(p, keys).unionByName(listing.not_found(p, keys, listing.NOT_FOUND_TO_EDIT))


def shelved_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products_both, from the layout for listings."""
    path = new_path(spark, "shelves")
    lay_out(from_tables(spark, sf_dir), path)
    return Shelves(spark, path).products_by("PROMO", "Brand#13")


def taken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored as objects, in two batches, under names that many share: what finds its name taken."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = text.object_path(text.file_ext(F.col("url")), F.lit(NOW) + F.col("page_id") % 40)
    found = pages.select(F.col("page_id").alias("source"), F.when(F.col("page_id") % 9 != 0, name).alias("path"), F.encode("html", "UTF-8").alias("content"))
    objects = Objects(spark, new_path(spark, "objects"))
    first = objects.put(found.where("source % 2 = 1"))
    return first.unionByName(objects.put(found.where("source % 2 = 0")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [feed, categories, brands_in_category, products_both, products_category, products_brand, products_all, product_detail, product_details, liked_set, owner_editable]
    own += [normalize_drafts, rejected_drafts, apply_update, owner_updates, refused_updates, added_products, empty_listings, apply_insert, image_path_fields, brand_route, listing_title, edit_form]
    own += [pinned_rows, patched_files, repeated_ids, feed_toggled, brands_after_changes, not_found_pages, shelved_products, taken_names]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return ORACLES
