"""The event queries as plain SQL: the JSON text is taken apart with the engine's own JSON functions."""

from __future__ import annotations

from cartloom.plans.adapters import view_sql
from cartloom.plans.url_oracle import ids_sql

RAW = f"""raw0 AS (SELECT event_id, raw, raw AS j FROM ({view_sql("raw_views")})),
    ev AS (SELECT *, {", ".join(f"json_type(j, '$.{f}') AS t_{f}" for f in ("store_id", "name", "url", "color", "rating", "category", "breadcrumbs", "description", "brand"))} FROM raw0)"""


def _texts(field: str) -> str:
    """Strings of a scalar-or-list field."""
    return (
        f"CASE json_type(j, '$.{field}') WHEN 'VARCHAR' THEN [json_extract_string(j, '$.{field}')]"
        f" WHEN 'ARRAY' THEN list_filter(cast(json_extract(j, '$.{field}') AS varchar[]), lambda x: x IS NOT NULL) ELSE [] END"
    )


def _strings(field: str) -> str:
    """A declared list of strings; anything else reads as missing."""
    return f"CASE WHEN json_type(j, '$.{field}') = 'ARRAY' THEN cast(json_extract(j, '$.{field}') AS varchar[]) END"


def _kept(items: str) -> str:
    return f"list_filter(coalesce({items}, []), lambda x: trim(x) <> '')"


def _first(field: str) -> str:
    return f"nullif(trim(({_texts(field)})[1]), '')"


def _all(field: str) -> str:
    return f"list_filter(list_transform({_texts(field)}, lambda x: trim(x)), lambda x: x <> '')"


def _number(c: str) -> str:
    return f"try_cast(regexp_extract(trim({c}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS double)"


def _scaled(textual: str) -> str:
    """Cents of an amount given as text."""
    n = _number(textual)
    return f"CASE WHEN {n} IS NULL THEN NULL WHEN contains({textual}, '.') OR {n} < 100 THEN cast(floor({n} * 100 + 0.5) AS bigint) ELSE cast({n} AS bigint) END"


def _amount(v: str) -> str:
    return f"({_scaled(v + " ->> '$'")})"


def _price(v: str) -> str:
    """Cents of a JSON price."""
    return (
        f"CASE json_type({v}) WHEN 'OBJECT' THEN {_amount(f"json_extract({v}, '$.amount')")} WHEN 'VARCHAR' THEN {_amount(v)}"
        f" WHEN 'ARRAY' THEN NULL WHEN 'NULL' THEN NULL ELSE cast(floor(try_cast({v} ->> '$' AS double) + 0.5) AS bigint) END"
    )


def _currency(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'OBJECT' THEN nullif(json_extract_string({v}, '$.currency'), '') END"


def _elements(field: str) -> str:
    return f"CASE WHEN json_type(j, '$.{field}') = 'ARRAY' THEN cast(json_extract(j, '$.{field}') AS json[]) ELSE [] END"


STORE = """CASE WHEN t_store_id IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(j, '$.store_id') WHEN t_store_id = 'VARCHAR' THEN nullif(trim(json_extract_string(j, '$.store_id')), '') END"""

_MAP_ENTRIES = "list_transform(coalesce(json_keys(j, '$.{0}'), []), lambda k: {{'k': k, 'v': json_extract(json_extract(j, '$.{0}'), '/' || replace(replace(k, '~', '~0'), '/', '~1'))}})".format


def _value_texts(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN [{v} ->> '$'] WHEN 'ARRAY' THEN cast({v} AS varchar[]) ELSE [] END"


def _map_values(field: str) -> str:
    return _kept(f"flatten(list_transform({_MAP_ENTRIES(field)}, lambda e: {_value_texts('e.v')}))")


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


SKUS = _distinct(
    "list_concat("
    + ", ".join(
        [
            _kept(_strings("sku")),
            _kept(_strings("sku_list")),
            _kept(f"list_transform({_elements('offers')}, lambda o: json_extract_string(o, '$.sku'))"),
            _kept(f"list_transform({_elements('offer_list')}, lambda o: json_extract_string(o, '$.offer_sku'))"),
            _map_values("urlToSku"),
            _map_values("priceToSku"),
        ]
    )
    + ")"
)
_PAIR = lambda a, b: _distinct(f"list_concat({_kept(_strings(a))}, {_kept(_strings(b))})")
IDENT = f"""ident AS (SELECT *, {SKUS} AS skus, {_PAIR('gtin', 'gtin_list')} AS gtins, {_PAIR('mpn', 'mpn_list')} AS mpns,
    {_PAIR('productID', 'productid_list')} AS product_ids, {STORE} AS store_id FROM ev)"""

_SIDE = f"""side AS (SELECT *, {_all('url')} AS urls, coalesce({_strings('image')}, {_strings('image_url_list')}, []) AS images,
    list_concat({_all('color')}, coalesce({_strings('color_list')}, [])) AS colors, {_elements('price')} AS prices FROM ident)"""


def _variant(sku: str, url: str, image: str, price: str, currency: str, color: str) -> str:
    blank = "CASE WHEN trim({0}) <> '' THEN {0} END".format
    return f"{{'sku': {sku}, 'url': nullif({url}, ''), 'image_url': {blank(image)}, 'price': {price}, 'currency': nullif({currency}, ''), 'color': {blank(color)}}}"


_NULL = "cast(NULL AS varchar)"
_AT = "nullif(coalesce(list_position(urls, e.k), 0), 0)"
URL_MAP = f"""flatten(list_transform({_MAP_ENTRIES('urlToSku')}, lambda e: list_transform({_kept(_value_texts('e.v'))}, lambda s:
    {_variant('s', 'e.k', f'images[{_AT}]', _price(f'prices[{_AT}]'), _currency(f'prices[{_AT}]'), f'colors[{_AT}]')})))"""
OFFERS = f"""list_transform(list_filter({_elements('offers')}, lambda o: coalesce(json_extract_string(o, '$.sku'), '') <> ''), lambda o:
    {_variant("json_extract_string(o, '$.sku')", "json_extract_string(o, '$.url')", _NULL, _price("json_extract(o, '$.price')"), _currency("json_extract(o, '$.price')"), _NULL)})"""
OFFER_LIST = f"""list_transform(list_filter({_elements('offer_list')}, lambda o: coalesce(json_extract_string(o, '$.offer_sku'), '') <> ''), lambda o:
    {_variant("json_extract_string(o, '$.offer_sku')", _NULL, _NULL, _amount("json_extract(o, '$.offer_amount')"), "json_extract_string(o, '$.offer_currency')", _NULL)})"""
_LAST = "list_filter(all_offers, lambda o: o.sku = s)[-1]"
PARALLEL = f"""list_transform(skus, lambda s, i: {_variant('s', f'coalesce(({_LAST}).url, urls[i])', 'images[i]', f'coalesce(({_LAST}).price, {_price("prices[i]")})',
    f'coalesce(({_LAST}).currency, CASE WHEN ({_LAST}).price IS NULL THEN {_currency("prices[i]")} END)', 'colors[i]')})"""
VARIANTS = f"""{RAW}, {IDENT}, {_SIDE}, built AS (SELECT *, {URL_MAP} AS v_map, {OFFERS} AS v_offers, {OFFER_LIST} AS v_list FROM side),
    parallel AS (SELECT *, {PARALLEL} AS v_par FROM (SELECT *, list_concat(v_offers, v_list) AS all_offers FROM built)),
    chosen AS (SELECT *, CASE WHEN json_type(j, '$.urlToSku') = 'OBJECT' AND len(json_keys(j, '$.urlToSku')) > 0 THEN v_map
        WHEN len(v_offers) > 0 THEN v_offers WHEN len(v_list) > 0 THEN v_list WHEN len(skus) > 0 THEN v_par ELSE [] END AS pick FROM parallel),
    vars AS (SELECT *, list_filter(pick, lambda x, i: list_position(list_transform(pick, lambda y: y.sku), x.sku) = i) AS variants FROM chosen)"""


def _variant_text(c: str) -> str:
    fields = " || ':' || ".join(f"coalesce(cast(x.{f} AS varchar), '-')" for f in ("sku", "url", "image_url", "price", "currency", "color"))
    return f"array_to_string(list_transform({c}, lambda x: {fields}), '|')"


def _variants_of(c: str) -> str:
    return f"WITH {VARIANTS} SELECT event_id, {_variant_text(c)} AS variants FROM vars WHERE len({c}) > 0"


def _s(field: str) -> str:
    return f"CASE WHEN trim(json_extract_string(j, '$.{field}')) <> '' THEN json_extract_string(j, '$.{field}') END"


def _head(field: str) -> str:
    return f"CASE WHEN trim(({_strings(field)})[1]) <> '' THEN ({_strings(field)})[1] END"


_OFFER1, _LIST1, _PRICE1, _CENTS1 = (f"({_elements(f)})[1]" for f in ("offers", "offer_list", "price", "priceInCents"))
_O = _price(f"json_extract({_OFFER1}, '$.price')")
_L = _amount(f"json_extract({_LIST1}, '$.offer_amount')")
_P = _price(_PRICE1)
_C = f"try_cast(regexp_extract({_CENTS1} ->> '$', '^[+-]?[0-9]+') AS bigint)"
_CUR = f"({_strings('priceCurrency')})[1]"
FIELDS = {
    "title": _first("name"),
    "url": f"coalesce({_head('canonical')}, {_first('url')}, {_s('product_url')}, {_s('page_url')})",
    "image_url": f"coalesce({_head('image')}, {_s('image_url')}, {_head('image_url_list')})",
    "brand": f"coalesce({_first('brand')}, {_head('brand_list')})",
    "description": _first("description"),
    "category": f"coalesce({_first('category')}, {_first('breadcrumbs')})",
    "color": f"coalesce({_first('color')}, {_head('color_list')})",
    "price": f"coalesce({_O}, {_L}, {_P}, {_C})",
    "currency": f"""CASE WHEN {_O} IS NOT NULL THEN {_currency(f"json_extract({_OFFER1}, '$.price')")} WHEN {_L} IS NOT NULL THEN json_extract_string({_LIST1}, '$.offer_currency')
        WHEN {_P} IS NOT NULL THEN coalesce({_currency(_PRICE1)}, {_CUR}) WHEN {_C} IS NOT NULL THEN {_CUR} END""",
}
RATING = f"""CASE WHEN t_rating = 'ARRAY' THEN CASE WHEN json_type(j, '$.rating[0]') = 'VARCHAR' THEN {_number("json_extract_string(j, '$.rating[0]')")} ELSE try_cast(json_extract_string(j, '$.rating[0]') AS double) END
    WHEN t_rating = 'VARCHAR' THEN {_number("json_extract_string(j, '$.rating')")} WHEN t_rating IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN try_cast(json_extract_string(j, '$.rating') AS double) END"""
_FIELD_LIST = ", ".join(f"{c} AS {n}" for n, c in FIELDS.items())

PRODUCTS = f"""{VARIANTS}, shaped AS (SELECT event_id, store_id, {_FIELD_LIST}, {RATING} AS rating, nullif(json_extract_string(j, '$.store_name'), '') AS store_name, variants, skus, gtins, mpns, product_ids FROM vars)"""


def _ids_of(rows: str, key: str) -> str:
    """Ids per key of (key, url, store_id) rows as a subquery."""
    return f"(WITH {ids_sql(rows, key=key)} SELECT {key}, CASE WHEN ids_ok THEN ids ELSE [] END AS extracted_ids FROM final)"


CARTS = f"""lines AS (SELECT event_id, j, pos - 1 AS item_pos, json_extract(j, '$.product_list[' || (pos - 1) || ']') AS item,
      CASE json_type(j, '$.store_id') WHEN 'VARCHAR' THEN nullif(trim(json_extract_string(j, '$.store_id')), '') ELSE json_extract_string(j, '$.store_id') END AS store_id
    FROM (SELECT event_id, raw AS j, unnest(range(1, cast(coalesce(json_array_length(raw, '$.product_list'), 0) AS bigint) + 1)) AS pos FROM ({view_sql("raw_carts")}))),
    typed AS (SELECT event_id, item_pos, store_id, item ->> '$.name' AS name, item ->> '$.url' AS url, item ->> '$.image_url' AS image_url,
      cast(item ->> '$.item_price' AS double) AS item_price, cast(item ->> '$.quantity' AS bigint) AS quantity, cast(item ->> '$.line_total' AS bigint) AS line_total FROM lines),
    valid AS (SELECT * FROM typed WHERE coalesce(trim(url), '') <> '' OR (coalesce(trim(name), '') <> '' AND item_price IS NOT NULL)),
    deduped AS MATERIALIZED (SELECT * FROM valid WHERE coalesce(trim(url), '') = '' UNION ALL
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id, url ORDER BY item_pos) AS rn FROM valid WHERE coalesce(trim(url), '') <> '') WHERE rn = 1)"""

_READABLE = "coalesce(json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT', false)"

ORACLE: dict[str, str] = {
    "read_product_views": f"WITH {RAW} SELECT {STORE} AS store_id, {_first('name')} AS name, coalesce(len({_strings('sku')}), -1) AS skus, count(*) AS events FROM ev GROUP BY 1, 2, 3",
    "read_cart_events": f"""SELECT CASE json_type(raw, '$.store_id') WHEN 'VARCHAR' THEN nullif(trim(json_extract_string(raw, '$.store_id')), '') ELSE json_extract_string(raw, '$.store_id') END AS store_id,
        coalesce(json_array_length(raw, '$.product_list'), 0) AS listed, json_extract_string(raw, '$.created_ts') AS created_ts, count(*) AS events FROM ({view_sql("raw_carts")}) GROUP BY 1, 2, 3""",
    "scalar_or_list_text": f"WITH {RAW} SELECT event_id, {_first('name')} AS first_name, array_to_string({_all('url')}, '|') AS urls, array_to_string({_all('color')}, '|') AS colors FROM ev",
    "first_number": f"WITH {RAW} SELECT event_id, {RATING} AS rating FROM ev",
    "price_to_cents": f"""WITH {RAW}, prices AS (
        SELECT event_id, 'price' AS place, unnest(range(0, len(ps))) AS pos, unnest(ps) AS p FROM (SELECT event_id, {_elements('price')} AS ps FROM ev)
        UNION ALL SELECT event_id, 'offer', unnest(range(0, len(ps))), unnest(ps) FROM (SELECT event_id, list_transform({_elements('offers')}, lambda o: json_extract(o, '$.price')) AS ps FROM ev))
        SELECT event_id, place, pos, {_price('p')} AS cents, {_currency('p')} AS currency FROM prices""",
    "coerce_store_id": f"WITH {RAW} SELECT event_id, {STORE} AS store_id FROM ev",
    "collect_identifiers": f"WITH {RAW}, {IDENT} SELECT event_id, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("skus", "gtins", "mpns", "product_ids")) + " FROM ident",
    "variants_from_url_map": _variants_of("v_map"),
    "variants_from_offers": _variants_of("v_offers"),
    "variants_from_offer_list": _variants_of("v_list"),
    "variants_from_parallel_arrays": _variants_of("v_par"),
    "choose_variants": _variants_of("variants"),
    "primary_fields": f"WITH {RAW} SELECT event_id, {_FIELD_LIST} FROM ev",
    "normalize_product_views": f"""WITH {PRODUCTS} SELECT s.event_id, title, s.url, cast(NULL AS varchar) AS canonical_url, image_url, s.store_id, store_name, brand, description, category, color, rating, price,
        nullif(currency, '') AS currency, len(variants) AS variant_count, len(variants) > 1 AS has_variants, array_to_string(product_ids, '|') AS product_ids,
        coalesce(array_to_string(x.extracted_ids, '|'), '') AS extracted_ids, CASE WHEN len(skus) > 0 THEN array_to_string(skus, '|') END AS skus,
        CASE WHEN len(gtins) > 0 THEN array_to_string(gtins, '|') END AS gtins, CASE WHEN len(mpns) > 0 THEN array_to_string(mpns, '|') END AS mpns,
        array_to_string(list_transform(variants, lambda v: v.sku), '|') AS variant_skus
        FROM shaped s LEFT JOIN {_ids_of("SELECT event_id, url, store_id FROM shaped", "event_id")} x ON s.event_id = x.event_id""",
    "normalize_views_without_metadata": f"""WITH {PRODUCTS} SELECT event_id, title, url, cast(NULL AS varchar) AS brand, cast(NULL AS bigint) AS price, cast(NULL AS varchar) AS skus, '' AS extracted_ids, len(variants) AS variant_count FROM shaped""",
    "product_variants": f"""WITH {PRODUCTS}, flat AS (SELECT event_id, store_id, variants, unnest(range(0, greatest(len(variants), 1))) AS pos FROM shaped),
        named AS (SELECT event_id || '#' || pos AS vkey, event_id, store_id, len(variants) AS n, CASE WHEN len(variants) > 0 THEN pos END AS variant_pos, variants[pos + 1] AS v, variants[pos + 1].url AS url FROM flat)
        SELECT event_id, n AS variant_count, n > 1 AS has_variants, variant_pos, v.sku AS sku, named.url, v.image_url AS image_url, v.price AS price, v.currency AS currency, v.color AS color,
        CASE WHEN len(x.extracted_ids) > 0 THEN array_to_string(x.extracted_ids, '|') END AS extracted_ids
        FROM named LEFT JOIN {_ids_of("SELECT vkey, url, store_id FROM named", "vkey")} x ON named.vkey = x.vkey""",
    "product_view_batch_summary": f"""SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) AS total_products
        FROM (SELECT {_READABLE} AS ok FROM ({view_sql('mixed_views')}))""",
    "validate_events": f"""WITH {RAW}, checked AS (SELECT event_id, list_filter([
        CASE WHEN NOT json_valid(j) THEN '$' END,
        CASE WHEN t_name NOT IN ('VARCHAR', 'ARRAY') THEN 'name' END,
        CASE WHEN json_type(j, '$.sku') <> 'ARRAY' THEN 'sku' END,
        CASE WHEN t_store_id NOT IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'store_id' END], lambda x: x IS NOT NULL) AS v FROM ev)
        SELECT event_id, len(v) = 0 AS is_valid, array_to_string(list_sort(v), '|') AS reason FROM checked""",
    "cart_lines": f"WITH {CARTS} SELECT event_id, item_pos, store_id, name, url, item_price FROM typed",
    "cart_line_filter": f"WITH {CARTS} SELECT event_id, item_pos, name, url FROM valid",
    "normalize_cart_events": f"""WITH {CARTS}, urls AS MATERIALIZED (SELECT row_number() OVER () AS ukey, * FROM (SELECT DISTINCT url, store_id FROM deduped)),
        x AS MATERIALIZED (SELECT * FROM {_ids_of("SELECT ukey, url, store_id FROM urls", "ukey")}),
        keyed AS (SELECT d.*, u.ukey FROM deduped d JOIN urls u ON d.url IS NOT DISTINCT FROM u.url AND d.store_id IS NOT DISTINCT FROM u.store_id)
        SELECT event_id, item_pos, CASE WHEN trim(name) <> '' THEN name END AS title, CASE WHEN trim(keyed.url) <> '' THEN keyed.url END AS url, CASE WHEN trim(image_url) <> '' THEN image_url END AS image_url,
        keyed.store_id, cast(item_price AS bigint) AS price, quantity, line_total, '' AS product_ids, coalesce(array_to_string(x.extracted_ids, '|'), '') AS extracted_ids
        FROM keyed LEFT JOIN x USING (ukey)""",
    "cart_dedup": f"""WITH l AS (SELECT *, coalesce(CASE WHEN trim(url) <> '' THEN url END, nullif(array_to_string(extracted_ids, '|'), '')) AS k FROM ({view_sql("cart_lines")}))
        SELECT session_id, item_pos, url, quantity FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY item_pos) AS rn FROM l) WHERE rn = 1 OR k IS NULL""",
    "cart_batch_summary": f"""WITH {CARTS}, m AS MATERIALIZED (SELECT event_id, {_READABLE} AS ok FROM ({view_sql("mixed_carts")})) SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
        (SELECT count(*) FROM deduped WHERE event_id IN (SELECT event_id FROM m WHERE ok)) AS total_products FROM m""",
    "validate_cart_events": f"""WITH m AS MATERIALIZED (SELECT event_id, CASE WHEN {_READABLE} THEN raw END AS j FROM ({view_sql("mixed_carts")}))
        SELECT event_id, j IS NOT NULL AS is_valid, CASE WHEN j IS NULL THEN '$' ELSE '' END AS reason FROM m""",
}
