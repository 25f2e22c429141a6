"""DuckDB SQL for the catalog queries."""

from __future__ import annotations

SPACES = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

PRODUCTS = """
sold AS (SELECT l_partkey, min(l_suppkey) AS owner, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS brand, p_retailprice::VARCHAR AS price, url, p_type AS category, NULL::VARCHAR AS image_url,
    CASE WHEN p_size % 17 <> 0 THEN shipped END AS created_at, CASE WHEN p_size % 10 <> 0 THEN owner::VARCHAR END AS owner_id
  FROM part LEFT JOIN sold ON l_partkey = p_partkey LEFT JOIN pages ON page_id = p_partkey)"""

LIKES = """
toggles AS (SELECT event_id AS seq, json_extract_string(props, '$.k') AS id FROM events WHERE event_type = 'click'),
likes AS (SELECT id, max(seq) AS liked_seq FROM toggles GROUP BY id HAVING count(*) % 2 = 1),
marked AS (SELECT p.*, l.id IS NOT NULL AS liked FROM products p LEFT JOIN likes l USING (id))"""

BASE = "created_at DESC NULLS FIRST, id"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


DRAFTS = f"""
drafts AS (
  SELECT p_partkey AS draft_id, CASE WHEN p_partkey % 13 <> 0 THEN 'file:///i/' || p_partkey || '.jpeg' END AS image_uri,
    CASE WHEN p_partkey % 7 = 0 THEN chr(9) || ' ' || chr(160) ELSE '  ' || p_name || chr(9) || chr(10) END AS title,
    chr(160) || p_brand || ' ' AS brand, CASE WHEN p_partkey % 3 = 0 THEN '   ' ELSE ' ' || p_retailprice::VARCHAR || chr(10) END AS price,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS category, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE ' ' || url || ' ' END AS url,
    CASE WHEN p_partkey % 17 <> 0 THEN 'u1' END AS user_id
  FROM part LEFT JOIN pages ON page_id = p_partkey),
valid AS (SELECT *, CASE WHEN image_uri IS NULL THEN 'image' WHEN {_trim('title')} = '' OR {_trim('brand')} = '' OR {_trim('category')} = '' THEN 'fields' WHEN user_id IS NULL THEN 'user' END AS reject_reason FROM drafts),
normal AS (
  SELECT {_trim('title')} AS title, {_trim('brand')} AS brand, nullif({_trim('price')}, '') AS price, {_trim('category')} AS category, nullif({_trim('url')}, '') AS url,
    'https://store/products/' || (1700000000000 + draft_id) || '.jpg' AS image_url, user_id AS owner_id, draft_id FROM valid WHERE reject_reason IS NULL)"""

ENCODE = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
EXT = "CASE WHEN x = 'jpeg' THEN 'jpg' ELSE x END"
CARD = "CASE WHEN price <> '' THEN price END AS price"
DETAIL = f"SELECT id, coalesce(nullif(image_url, ''), 'No Image') AS image, brand, upper(brand) AS brand_label, title, 'Category: ' || nullif(category, '') AS category, {CARD}, CASE WHEN url <> '' THEN 'Open Link' ELSE 'No Link' END AS link, liked FROM marked"
ROWS = "SELECT id, brand, title, price, url FROM products"


def _seen(column: str, where: str = "true", more: str = "") -> str:
    return f"""WITH {PRODUCTS}, placed AS (SELECT *, row_number() OVER (ORDER BY {BASE}) AS ord FROM products),
firsts AS (SELECT {column}, min(ord) AS ord FROM placed WHERE {where} GROUP BY {column})
SELECT {column}{more}, row_number() OVER (ORDER BY ord) - 1 AS pos FROM firsts"""


def _update(where: str) -> str:
    return f"""WITH {PRODUCTS}, m AS (SELECT *, {where} AS hit FROM products)
SELECT id, CASE WHEN hit THEN title || ' v2' ELSE title END AS title, brand, CASE WHEN NOT hit THEN price END AS price,
  CASE WHEN NOT hit THEN url WHEN id::BIGINT % 2 = 1 THEN 'http://n' END AS url, category, image_url, created_at, owner_id FROM m"""


ORACLES = {
    "feed": f"WITH {PRODUCTS}, {LIKES} SELECT row_number() OVER (ORDER BY liked DESC, {BASE}) - 1 AS pos, id, coalesce(nullif(image_url, ''), 'IMG') AS image, brand, upper(brand) AS brand_label, title, {CARD}, liked FROM marked",
    "categories": _seen("category", more=", upper(category) AS label"),
    "brands_in_category": _seen("brand", "category = 'PROMO'"),
    "products_both": f"WITH {PRODUCTS} {ROWS} WHERE category = 'PROMO' AND brand = 'Brand#13'",
    "products_category": f"WITH {PRODUCTS} {ROWS} WHERE category = 'PROMO'",
    "products_brand": f"WITH {PRODUCTS} {ROWS} WHERE brand = 'Brand#13'",
    "products_all": f"WITH {PRODUCTS} {ROWS}",
    "product_detail": f"WITH {PRODUCTS}, {LIKES} {DETAIL} WHERE id = '7'",
    "product_details": f"WITH {PRODUCTS}, {LIKES} {DETAIL}",
    "liked_set": f"WITH {PRODUCTS}, {LIKES} SELECT id, liked_seq FROM likes",
    "owner_editable": f"WITH {PRODUCTS} SELECT id, coalesce(owner_id, '') = '1' AS by_user, coalesce(owner_id, '') = '' AS by_nobody, false AS strict FROM products",
    "normalize_drafts": f"WITH {DRAFTS} SELECT * FROM normal",
    "rejected_drafts": f"WITH {DRAFTS} SELECT draft_id, reject_reason FROM valid WHERE reject_reason IS NOT NULL",
    "apply_update": _update("id::BIGINT % 5 = 0 AND id::BIGINT % 35 <> 0"),
    "owner_updates": _update("id::BIGINT % 5 = 0 AND id::BIGINT % 35 <> 0 AND coalesce(owner_id, '') = '1'"),
    "refused_updates": f"""WITH {PRODUCTS} SELECT 'x' || id AS id, 'product' AS reject_reason FROM products WHERE id::BIGINT % 5 = 0
UNION ALL SELECT id, CASE WHEN coalesce(owner_id, '') <> '1' THEN 'owner' ELSE 'fields' END FROM products WHERE id::BIGINT % 5 = 0 AND (coalesce(owner_id, '') <> '1' OR id::BIGINT % 35 = 0)""",
    "added_products": f"WITH {PRODUCTS} SELECT 'n' || id AS id, title, brand, price, url, category, NULL::VARCHAR AS image_url, TIMESTAMP '2023-11-14 22:13:20' AS created_at, NULL::VARCHAR AS owner_id FROM products",
    "empty_listings": f"""WITH {PRODUCTS}, asked(asked, category, brand, message) AS (VALUES
  ('both', 'PROMO', 'Brand#13', 'No products yet for this brand in this category.'), ('nobody', 'PROMO', 'nobody', 'No products yet for this brand in this category.'),
  ('shoes', 'shoes', NULL, 'No brands yet for this category.'), ('PROMO', 'PROMO', NULL, 'No brands yet for this category.'))
SELECT asked, message FROM asked a WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.category = a.category AND (a.brand IS NULL OR p.brand = a.brand))""",
    "apply_insert": f"""WITH {PRODUCTS}, {DRAFTS}, both_ AS (SELECT 0 AS old, 'n' || draft_id AS id, title, owner_id, NULL::TIMESTAMP AS created_at FROM normal UNION ALL SELECT 1, id, title, owner_id, created_at FROM products)
SELECT row_number() OVER (ORDER BY old, {BASE}) - 1 AS pos, id, title, owner_id FROM both_""",
    "image_path_fields": f"""WITH e AS (SELECT page_id, lower(string_split(string_split(url, '.')[-1], '?')[1]) AS x FROM pages), f AS (SELECT page_id, {EXT} AS ext FROM e)
SELECT page_id, ext, 'image/' || CASE WHEN ext = 'jpg' THEN 'jpeg' ELSE ext END AS mime, 'products/1700000000000.' || ext AS path, 'https://store/products/1700000000000.' || ext AS public_url FROM f""",
    "brand_route": f"WITH {PRODUCTS} SELECT id, '/shoe-products?category=' || category || '&brand=' || {ENCODE.format('brand')} AS route, '/shoe-brands?category=' || category AS category_route, '/' || id AS product_route, {ENCODE.format('url')} AS encoded FROM products",
    "listing_title": f"WITH {PRODUCTS} SELECT DISTINCT brand, category, brand || ' · ' || upper(category) AS both, 'Products · ' || upper(category) AS no_brand, brand || ' ' AS no_category FROM products",
    "edit_form": f"WITH {PRODUCTS} SELECT id, coalesce(title, '') AS title, coalesce(brand, '') AS brand, coalesce(price, '') AS price, coalesce(category, 'shoes') AS category, coalesce(url, '') AS url FROM products",
    "pinned_rows": f"WITH {PRODUCTS} SELECT * FROM products",
    "patched_files": _update("id::BIGINT % 5 = 0 AND id::BIGINT % 35 <> 0"),
    "repeated_ids": f"""WITH {PRODUCTS}, named AS (SELECT CASE WHEN id::BIGINT % 50 <> 0 THEN CASE id::BIGINT % 3 WHEN 0 THEN id WHEN 1 THEN 'n' || id ELSE 't' || (id::BIGINT // 6) END END AS key FROM products)
SELECT key, CASE WHEN key IS NULL THEN 'missing' WHEN key IN (SELECT id FROM products) THEN 'stored' ELSE 'twice' END AS reject_reason
FROM named GROUP BY key HAVING key IS NULL OR count(*) > 1 OR key IN (SELECT id FROM products)""",
    "taken_names": f"""WITH e AS (SELECT page_id, lower(string_split(string_split(url, '.')[-1], '?')[1]) AS x FROM pages),
named AS (SELECT page_id AS source, CASE WHEN page_id % 9 <> 0 THEN 'products/' || (1700000000000 + page_id % 40) || '.' || {EXT} END AS path FROM e),
firsts AS (SELECT path, arg_min(source, (source % 2 = 0, source)) AS first FROM named GROUP BY path)
SELECT source, n.path, CASE WHEN n.path IS NULL THEN 'missing' ELSE 'taken' END AS reject_reason FROM named n LEFT JOIN firsts f ON n.path = f.path WHERE n.path IS NULL OR source <> first""",
    "brands_after_changes": f"""WITH {PRODUCTS}, now AS (
  SELECT id, created_at, CASE WHEN id::BIGINT % 7 = 0 THEN brand || 'x' ELSE brand END AS brand FROM products UNION ALL
  SELECT 'n' || id, TIMESTAMP '2023-11-14 22:13:20', brand FROM products WHERE id LIKE '%3'),
placed AS (SELECT *, row_number() OVER (ORDER BY {BASE}) AS ord FROM now), firsts AS (SELECT brand, min(ord) AS ord FROM placed GROUP BY brand)
SELECT brand, row_number() OVER (ORDER BY ord) - 1 AS pos FROM firsts""",
    "not_found_pages": f"""WITH {PRODUCTS}, {LIKES}, clicked AS (SELECT DISTINCT id FROM toggles), keys AS (SELECT id AS key FROM clicked UNION ALL SELECT '0' || id FROM clicked)
SELECT key, message FROM keys, (VALUES ('Not found'), ('Product not found')) v(message) WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.id = key AND category <> 'PROMO')""",
}
ORACLES["feed_toggled"] = ORACLES["feed"]
ORACLES["shelved_products"] = ORACLES["products_both"]
