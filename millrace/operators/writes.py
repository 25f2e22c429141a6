"""Drafts and patches: validation, normalisation, insertion and copy-on-write update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, file_ext, now_millis, object_path, owned_by, present, public_url, trimmed
from millrace.operators.listing import age, positions
from millrace.sources.objects import Objects
from millrace.sources.products import COLUMNS
from millrace.sources.shared import table
from millrace.sources.versions import Versioned

#: What a patch sets, and how each is cleaned.
FIELDS = {"title": trimmed, "brand": trimmed, "category": trimmed, "price": blank_to_null, "url": blank_to_null}


def _fields_missing() -> Column:
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    return blank("title") | blank("brand") | blank("category")


def validated(drafts: DataFrame) -> DataFrame:
    """drafts with reject_reason: the first of image, fields and user that fails, else null."""
    reason = F.when(~present(F.col("image_uri")), "image").when(_fields_missing(), "fields").when(~present(F.col("user_id")), "user")
    return drafts.withColumn("reject_reason", reason)


def normalised(drafts: DataFrame, base_url: str, millis: Column | None = None) -> DataFrame:
    """The valid drafts' columns as they are stored: the image by its public address, not by the draft's local one.

    millis: the time in the object's name, which names the object, so that drafts taken at once need different ones. By default
    it is the clock's time and a number of the draft's own within the job.
    """
    own = F.concat(now_millis().cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string"))
    image = object_path(file_ext(F.col("image_uri")), own if millis is None else millis)
    return validated(drafts).where("reject_reason is null").select(
        trimmed(F.col("title")).alias("title"),
        trimmed(F.col("brand")).alias("brand"),
        blank_to_null(F.col("price")).alias("price"),
        trimmed(F.col("category")).alias("category"),
        blank_to_null(F.col("url")).alias("url"),
        public_url(base_url, image).alias("image_url"),
        F.col("user_id").alias("owner_id"),
        *[c for c in drafts.columns if c not in COLUMNS and c not in ("image_uri", "user_id")],
    )


def added(inputs: DataFrame, now: Column) -> DataFrame:
    """Products as stored from inputs (id, title, brand, price, url, category, perhaps image_url): no owner, no image if none is given."""
    image = F.col("image_url") if "image_url" in inputs.columns else F.lit(None)
    return inputs.withColumns({"image_url": image.cast("string"), "owner_id": F.lit(None).cast("string"), "created_at": now.cast("timestamp_ntz")}).select(*COLUMNS)


def rejected(drafts: DataFrame) -> DataFrame:
    return validated(drafts).where("reject_reason is not null")


def prepended(products: DataFrame, new: DataFrame) -> DataFrame:
    """All rows with `pos`: the new ones first, by id, then the old ones in base order."""
    both = new.select(*COLUMNS, F.lit(0).alias("_old")).unionByName(products.select(*COLUMNS, F.lit(1).alias("_old")))
    old_age = F.when(F.col("_old") == 1, age(F.col("created_at")))
    return positions(both, F.col("_old"), old_age.asc_nulls_first(), F.col("id")).drop("_old")


def latest(patches: DataFrame) -> DataFrame:
    """One patch for each id: of several the one of the largest `seq`, without that column the largest by its fields."""
    order = ["seq"] if "seq" in patches.columns else []
    fields = F.struct(*order, *FIELDS)
    return patches.groupBy("id").agg(F.max(fields).alias("p")).select("id", *[F.col(f"p.{c}").alias(c) for c in FIELDS])


def refused(products: DataFrame, patches: DataFrame, user: str | None) -> DataFrame:
    """(id, reject_reason) of the patches that change nothing: `product` is not there, `owner` is another, or `fields` are missing, in this order."""
    known = products.select("id", owned_by(F.col("owner_id"), user).alias("_own"))
    reason = F.when(F.col("_own").isNull(), "product").when(~F.col("_own"), "owner").when(_fields_missing(), "fields")
    return latest(patches).join(known, "id", "left").select("id", reason.alias("reject_reason")).where("reject_reason is not null")


def updated(products: DataFrame, patches: DataFrame, user: str | None = None, check_owner: bool = False) -> DataFrame:
    """The whole table after valid patches: title, brand, category, price and url change, the rest stays.

    check_owner: only rows that `user` owns change; `refused` tells which patches do not. Of several patches of an id
    the latest counts. Plain files can't be updated in place: write the result elsewhere.
    """
    new = latest(patches).where(~_fields_missing()).select("id", F.struct(*[f(F.col(c)).alias(c) for c, f in FIELDS.items()]).alias("_new"))
    allowed = owned_by(F.col("owner_id"), user) if check_owner else F.lit(True)
    change = F.col("_new").isNotNull() & allowed
    both = products.join(new, "id", "left")
    return both.select(*[F.when(change, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in COLUMNS])


def patch_files(products: Versioned, patches: DataFrame, user: str | None = None, check_owner: bool = False) -> list[str]:
    """`updated` on a Versioned table, in one commit: only the files that hold a patched id are written again; gives those."""
    keys = latest(patches).where(~_fields_missing()).select(F.col("id").alias("key"))
    return products.rewrite(keys, lambda rows: updated(rows, patches, user, check_owner))


def upload(drafts: DataFrame, images: DataFrame, objects: Objects, products: Versioned, base_url: str, now: Column) -> DataFrame:
    """Stores the images of valid drafts and then their products; gives (draft_id, reject_reason) of those not stored.

    drafts: those of `validated`, with draft_id (unique); images: (image_uri, content). Reasons are those of `validated`, then
    `unread`, where there is no such image, and `taken`, where the image's name is. A product's id is its image's name, which is its
    own since names are taken once.
    """
    judged = table(validated(drafts))
    valid = judged.where("reject_reason is null").drop("reject_reason")
    path = object_path(file_ext(F.col("image_uri")), F.concat(F.unix_millis(now).cast("string"), F.lit("-"), F.col("draft_id").cast("string")))
    named = table(valid.join(images.select("image_uri").distinct(), "image_uri", "left_semi").withColumn("path", path))
    taken = objects.put(named.join(images, "image_uri").select(F.col("draft_id").alias("source"), "path", "content"))
    good = named.join(taken.select(F.col("source").alias("draft_id")), "draft_id", "left_anti")
    fields = {c: f(F.col(c)) for c, f in FIELDS.items()}
    rows = good.withColumns(fields | {"id": F.col("path"), "image_url": public_url(base_url, F.col("path")), "owner_id": F.col("user_id"), "created_at": now.cast("timestamp_ntz")})
    products.append(rows.select(*COLUMNS))
    unread = valid.join(named.select("draft_id"), "draft_id", "left_anti").select("draft_id", F.lit("unread").alias("reject_reason"))
    bad = judged.where("reject_reason is not null").select("draft_id", "reject_reason")
    return bad.unionByName(unread).unionByName(taken.select(F.col("source").alias("draft_id"), "reject_reason"))
