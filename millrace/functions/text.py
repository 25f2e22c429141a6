"""Column functions of the catalog: presence, trimming, URL parts, labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming takes off, as a Java character class.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# What url_encode escapes and a URI component does not, and the space.
UNESCAPED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def present(c: Column) -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(c != "", F.lit(False))


def trimmed(c: Column) -> Column:
    """Without white space at both ends, beyond ASCII as well. Null stays null."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def uri_component(c: Column) -> Column:
    """Percent-encoded for a route; A-Z a-z 0-9 - _ . ! ~ * ' ( ) stay."""
    out = F.url_encode(c)
    for escaped, plain in UNESCAPED.items():
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def file_ext(uri: Column) -> Column:
    """What stands after the last dot and before a question mark, in lower case, jpeg as jpg; all of it without a dot."""
    ext = F.lower(F.substring_index(F.substring_index(uri, ".", -1), "?", 1))
    return F.when(ext == "jpeg", "jpg").otherwise(ext)


def mime_type(ext: Column) -> Column:
    return F.concat(F.lit("image/"), F.when(ext == "jpg", "jpeg").otherwise(ext))


def object_path(ext: Column, millis: Column) -> Column:
    return F.concat(F.lit("products/"), millis.cast("string"), F.lit("."), ext)


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def public_url(base: str, path: Column) -> Column:
    """The address of a stored object; empty for no path."""
    return F.coalesce(F.concat(F.lit(base), path), F.lit(""))


# Fixed values in the functions below: titles, labels and routes as the screens spell them.


def listing_title(brand: Column, category: Column) -> Column:
    """The brand, or 'Products', a space, and the category in capitals if there is one."""
    name = F.when(present(brand), brand).otherwise("Products")
    return F.concat(name, F.lit(" "), F.when(present(category), F.concat(F.lit("· "), F.upper(category))).otherwise(""))


def category_label(category: Column) -> Column:
    """Null for no category."""
    return F.when(present(category), F.concat(F.lit("Category: "), category))


def link_label(url: Column) -> Column:
    return F.when(present(url), "Open Link").otherwise("No Link")


def brand_route(category: Column, brand: Column) -> Column:
    """The route to a brand's products; only the brand is encoded."""
    return F.concat(F.lit("/shoe-products?category="), category, F.lit("&brand="), uri_component(brand))


def category_route(category: Column) -> Column:
    return F.concat(F.lit("/shoe-brands?category="), category)


def product_route(key: Column) -> Column:
    """The route to one product's page."""
    return F.concat(F.lit("/"), uri_component(key.cast("string")))


def owned_by(owner: Column, user: str | None, strict: bool = False) -> Column:
    """Whether owner and user are the same; null and empty are one. strict: nobody owns what has no owner."""
    same = F.coalesce(owner.cast("string"), F.lit("")) == F.lit(user or "")
    return same & present(owner.cast("string")) if strict else same
