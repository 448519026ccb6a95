"""Commerce inputs derived from the given tables.

Each input is one SELECT that runs unchanged on Spark and, for checking, on another SQL engine: only the spelling of
arrays and structs differs and comes from the dialect. Positions inside a session are sortable texts built from the row's
own key, so no input needs a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartloom.session import bucketed

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]


@dataclass(frozen=True)
class Dialect:
    name: str

    def arr(self, *items: str) -> str:
        fn = "array" if self.name == "spark" else "list_value"
        return f"{fn}({', '.join(items)})"

    def struct(self, **fields: str) -> str:
        if self.name == "spark":
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")

_POS = (
    "lpad(cast(l_linenumber as string), 2, '0') || '-' || lpad(cast(l_partkey as string), 12, '0') || '-' || "
    "lpad(cast(l_suppkey as string), 12, '0') || '-' || cast(cast(l_quantity as bigint) as string)"
)
_SKU = "'SK' || cast(100000 + l_partkey as string)"
_SHOP_URL = "'https://www.shop.example.com/product/prod-' || cast(100000 + l_partkey as string)"
_COLOR = "split_part(p_name, ' ', 1)"
_CART_TITLE = f"""CASE
        WHEN l_partkey % 15 = 0 THEN p_name || ' Red M:- Red, M'
        WHEN l_partkey % 6 = 3 THEN p_name || ' - Teal'
        WHEN l_partkey % 3 = 0 THEN p_name || ' - ' || {_COLOR}
        WHEN l_partkey % 7 = 2 THEN 'Acme ' || p_name
        WHEN l_partkey % 7 = 4 THEN replace(p_name, 'e', 'a') || ' XL!'
        WHEN l_partkey % 11 = 5 THEN p_name || ' - 42'
        ELSE upper(p_name) END"""
_CART_IMAGE = f"""CASE WHEN l_partkey % 5 = 1 THEN NULL WHEN l_partkey % 5 = 2 THEN 'https://img.example.com/x/photo' || cast(1000000 + l_partkey as string) || '.jpg'
        ELSE 'https://img.example.com/x/' || {_SKU} || '_main.jpg' END"""


def product_urls(d: Dialect) -> str:
    """URLs of many shapes, with and without a store id, some of them broken."""
    k = "cast({} + p_partkey as string)".format
    return f"""
    SELECT p_partkey AS page_id,
      CASE p_partkey % 13
        WHEN 0 THEN 'https://www.target.com/p/x/-/A-' || {k(10000000)}
        WHEN 1 THEN 'http://shop.example.com/product/prod-' || {k(100000)} || '?utm_source=a'
        WHEN 2 THEN 'https://example.com/item?sku=' || {k(10000)} || '&ref=z'
        WHEN 3 THEN 'https://oldnavy.gap.com/browse/product.do?pid=' || {k(1000000)}
        WHEN 4 THEN 'www.' || CASE p_partkey % 4 WHEN 0 THEN 'example.co.uk' WHEN 1 THEN 'alpha.com.gr' WHEN 2 THEN 'beta.com.gr' ELSE 'shop.gamma.co.hu' END || '/a/' || {k(100000)} || '.html'
        WHEN 5 THEN 'https://www.samsclub.com/ip/slug/prod' || {k(20000000)}
        WHEN 6 THEN 'https://temu.com//lamp-g-' || {k(510000000000)} || '.html?sku_id=' || {k(73300000000)} || '&goods_id=' || {k(420000000000)}
        WHEN 7 THEN 'HTTPS://M.Kohls.com/product/prd-' || {k(1000000)} || '/a.jsp?skuId=' || {k(70000000)} || '#frag'
        WHEN 8 THEN CASE p_partkey % 3 WHEN 0 THEN 'ftp://files.example.com/' || {k(0)} WHEN 1 THEN '' ELSE 'no url ' || {k(0)} END
        WHEN 9 THEN 'https://coachoutlet.com/on/x?b=2&a=1&pid=ABCDEFGHIJKLMNOPQRST' || {k(100000)}
        WHEN 10 THEN 'https://www.ikea.com/us/en/p/chair-s' || {k(80000000)} || '/'
        WHEN 11 THEN 'http://10.0.0.' || cast(p_partkey % 200 as string) || ':8080/product/p' || {k(100000)}
        ELSE 'https://a.b.myshopify.com/products/p-' || {k(100000)} || '/prd' || {k(200000)} || '?variant=' || {k(40000000)} || '&id=' || {k(1000)}
      END AS url,
      CASE p_partkey % 13
        WHEN 0 THEN '5246' WHEN 3 THEN '3726' WHEN 5 THEN '999999'
        WHEN 9 THEN CASE WHEN p_partkey % 2 = 0 THEN '' ELSE NULL END END AS store_id
    FROM {{part}}"""


def golden_urls(d: Dialect) -> str:
    """Golden cases, one per part in three URL shapes; every eleventh expects a wrong id and must fail."""
    k = "cast({} + p_partkey as string)".format
    wrong = "CASE WHEN p_partkey % 11 = 6 THEN 'wrong' ELSE {} END".format
    return f"""
    SELECT p_partkey AS case_id,
      CASE p_partkey % 3 WHEN 0 THEN 'Target' WHEN 1 THEN 'Generic' ELSE 'Kohls' END AS store_name,
      CASE WHEN p_partkey % 3 = 0 THEN '5246' END AS store_id,
      CASE p_partkey % 3 WHEN 0 THEN 'https://www.target.com/p/x/-/A-' || {k(10000000)}
        WHEN 1 THEN 'https://www.example.org/product/P-' || {k(1000000)} || '?utm_id=1'
        ELSE 'https://www.kohls.com/product/prd-' || {k(1000000)} || '/n.jsp' END AS url,
      CASE p_partkey % 3 WHEN 0 THEN {d.arr(wrong(k(10000000)))}
        WHEN 1 THEN {d.arr("'P-' || " + k(1000000), wrong(k(1000000)))}
        ELSE {d.arr(wrong("'prd-' || " + k(1000000)), k(1000000))} END AS expected_skus
    FROM {{part}}"""


def cart_lines(d: Dialect) -> str:
    """Cart lines: titles with colour suffixes and typos, some lines without URL, image or caller-given SKU."""
    return f"""
    SELECT l_orderkey AS session_id, {_POS} AS item_pos, {_CART_TITLE} AS title,
      CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN upper({_SHOP_URL}) || '/' ELSE {_SHOP_URL} END AS url,
      {_CART_IMAGE} AS image_url,
      cast(l_orderkey % 50 as string) AS store_id,
      cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) AS price,
      cast(l_quantity as bigint) AS quantity,
      cast(floor(l_extendedprice * 100 + 0.5) as bigint) AS line_total,
      cast({d.arr()} as string{'' if d.name == 'spark' else '[]'}) AS product_ids,
      CASE WHEN l_partkey % 4 = 0 THEN {_empty(d)}
        ELSE {d.arr("cast(100000 + l_partkey as string)", "'prod-' || cast(100000 + l_partkey as string)")} END AS extracted_ids,
      CASE WHEN l_partkey % 6 = 1 THEN {d.arr(_SKU)} WHEN l_partkey % 6 = 4 THEN {d.arr(_SKU + " || 'V2'", "'X' || " + _SKU)} END AS skus,
      {_none(d)} AS gtins, {_none(d)} AS mpns
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""".replace(
        f"cast({d.arr()} as string{'' if d.name == 'spark' else '[]'})", _empty(d)
    )


def _empty(d: Dialect) -> str:
    return "cast(array() as array<string>)" if d.name == "spark" else "cast([] as varchar[])"


def _none(d: Dialect) -> str:
    return "cast(null as array<string>)" if d.name == "spark" else "cast(null as varchar[])"


def viewed_products(d: Dialect) -> str:
    """Normalised products viewed in the session, about two thirds of the cart lines, some with two variants."""
    num = "cast(100000 + l_partkey as string)"

    def variant(suffix: str, color: str, cents: str) -> str:
        return d.struct(
            sku=f"{_SKU} || '{suffix}'",
            url=f"{_SHOP_URL} || '/{suffix}'",
            image_url=f"'https://img.example.com/v/' || {num} || '{suffix}.png'",
            price=f"cast({cents} as bigint)",
            currency="'EUR'",
            color=color,
            extracted_ids=d.arr(f"{num} || '{suffix}'", num),
        )

    cents = "floor(p_retailprice * 100 + 0.5)"
    variants = d.arr(variant("V1", _COLOR, cents), variant("V2", "'teal'", f"{cents} + 500"))
    return f"""
    SELECT l_orderkey AS session_id, {_POS} AS product_pos, p_name AS title,
      CASE WHEN l_partkey % 8 = 7 THEN NULL ELSE {_SHOP_URL} END AS url,
      'https://img.example.com/p/' || {num} || '.jpg' AS image_url,
      CASE WHEN l_orderkey % 97 = 5 THEN 'other' ELSE cast(l_orderkey % 50 as string) END AS store_id,
      p_brand AS brand, 'About ' || p_name AS description, p_type AS category, cast(p_size as double) / 10 AS rating,
      cast({cents} as bigint) AS price,
      CASE WHEN l_partkey % 2 = 0 THEN 'USD' END AS currency,
      CASE WHEN l_partkey % 2 = 0 THEN upper({_COLOR}) END AS color,
      {d.arr("'P' || " + num)} AS product_ids,
      CASE WHEN l_partkey % 5 = 0 THEN {_empty(d)} ELSE {d.arr(num)} END AS extracted_ids,
      CASE WHEN l_partkey % 10 < 4 THEN {d.arr(_SKU, num)} END AS skus,
      CASE WHEN l_partkey % 9 = 0 THEN {d.arr("'00' || " + num)} END AS gtins,
      {_none(d)} AS mpns,
      CASE WHEN l_partkey % 3 = 1 THEN {variants} ELSE {_slice0(d, variants)} END AS variants
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
    WHERE (l_partkey + l_suppkey) % 3 <> 0"""


def _slice0(d: Dialect, items: str) -> str:
    return f"slice({items}, 1, 0)" if d.name == "spark" else f"list_slice({items}, 1, 0)"


def store_registry(d: Dialect) -> str:
    """A registry with one store per supplier: some without id, some ids used twice, some with aliases and rules."""
    k = "cast(s_suppkey as string)"
    alias = d.arr(
        d.struct(id=f"'a' || {k}", domain=f"'alias' || {k} || '.com'"),
        d.struct(id=f"cast(s_suppkey + 1 as string)", domain=f"'twin' || cast(s_suppkey / 2 as bigint) || '.com'"),
    )
    return f"""
    SELECT s_suppkey AS pos,
      CASE WHEN s_suppkey % 25 = 7 THEN NULL WHEN s_suppkey % 10 = 9 THEN cast(s_suppkey - 1 as string) ELSE {k} END AS id,
      'store' || {k} || '.com' AS domain,
      CASE WHEN s_suppkey % 4 = 0 THEN {alias} ELSE {_slice0(d, alias)} END AS aliases,
      CASE s_suppkey % 3 WHEN 0 THEN {d.arr(r"'-item([0-9]{{4,12}})'", r"'/sku/([a-z]{{2}}[0-9]+)'")} WHEN 1 THEN {d.arr(r"'/sku/([a-z]{{2}}[0-9]+)'")} ELSE {_empty(d)} END AS path_patterns,
      CASE WHEN s_suppkey % 5 = 0 THEN {d.arr(r"'code=([0-9]{{3,12}})'")} ELSE {_empty(d)} END AS query_patterns,
      CASE WHEN s_suppkey % 7 = 1 THEN 'sk' END AS rewrite_find,
      CASE WHEN s_suppkey % 7 = 1 THEN 'sku-' END AS rewrite_to
    FROM {{supplier}}"""


def registry_snapshots(d: Dialect) -> str:
    """Four weekly registries: stores come, go and come again, and some change their rules."""
    return f"""
    SELECT pos, id, CASE WHEN pos % 13 = 5 AND week > 1 THEN 'moved' || cast(pos as string) || '.com' ELSE domain END AS domain, aliases, path_patterns, query_patterns,
      CASE WHEN pos % 3 = 1 AND week > 0 THEN 'sk' ELSE rewrite_find END AS rewrite_find,
      CASE WHEN pos % 3 = 1 AND week > 0 THEN 'week' || cast(floor(week / 2) as bigint) || '-' ELSE rewrite_to END AS rewrite_to, valid_from
    FROM ({store_registry(d)}) r CROSS JOIN (VALUES (0, timestamp '2024-01-03 00:00:00'), (1, timestamp '2024-01-10 00:00:00'), (2, timestamp '2024-01-17 12:00:00'), (3, timestamp '2024-01-24 00:00:00')) AS weeks(week, valid_from)
    WHERE (pos + week) % 6 <> 0"""


def store_visits(d: Dialect) -> str:
    """Events as visits of a store by id or, one in four, by domain."""
    return """
    SELECT event_id, ts, CASE WHEN event_id % 4 <> 0 THEN cast(user_id as string) ELSE CASE event_id % 8 WHEN 0 THEN '' END END AS store_id,
      CASE WHEN event_id % 12 = 0 THEN 'moved' ELSE 'store' END || cast(user_id as string) || '.com' AS domain
    FROM {events}"""


def url_log(d: Dialect) -> str:
    """Logged product URLs per supplier store with the ids that earlier jobs found, many of them blank."""
    return f"""
    SELECT l_orderkey || '-' || {_POS} AS row_id,
      'https://www.store' || cast(l_suppkey as string) || '.com/c-item' || cast(1000 + l_partkey as string)
        || '/sku/sk' || cast(l_partkey as string) || '?code=' || cast(100 + l_linenumber as string) AS url,
      CASE WHEN l_partkey % 40 = 13 THEN '  ' WHEN l_partkey % 40 = 14 THEN 'x' || cast(l_suppkey as string) ELSE cast(l_suppkey as string) END AS store_id,
      CASE WHEN l_suppkey % 9 = 4 THEN ' ' ELSE 'Supplier ' || cast(l_suppkey as string) END AS store_name,
      CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE cast(1000 + l_partkey as string) END AS url_ids_csv,
      CASE l_partkey % 6 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN 'broken[' WHEN 3 THEN '"text"'
        ELSE '["' || cast(l_suppkey as string) || '-' || cast(l_partkey as string) || '"]' END AS product_ids,
      cast(l_shipdate as date) AS insert_date
    FROM {{lineitem}}"""


def store_catalog(d: Dialect) -> str:
    """Catalog entries as the catalog service lists them; attributes are an object or a plain text."""
    return """
    SELECT CASE WHEN s_suppkey % 12 = 11 THEN s_suppkey + 100000 ELSE s_suppkey END AS id, s_name AS name,
      CASE s_suppkey % 4 WHEN 0 THEN '{{"productSearchEnabled":true}}' WHEN 1 THEN '{{"productSearchEnabled":false,"x":1}}'
        WHEN 2 THEN '{{"productSearchEnabled":true,"x":"y"}}' ELSE '""' END AS attributes
    FROM {supplier}"""


def raw_views(d: Dialect) -> str:
    """Raw product-view events as JSON text in the shapes that both client kinds send."""
    k = "cast(l_partkey as string)"
    url = f"'https://www.shop.example.com/product/prod-' || cast(100000 + l_partkey as string)"
    price = "cast(cast(900 + l_partkey % 500 as bigint) as string)"
    q = "'\"'"
    return f"""
    SELECT l_orderkey || '-' || {_POS} AS event_id, l_orderkey AS session_id, {_POS} AS product_pos,
      CASE l_partkey % 7
        WHEN 0 THEN '{{{{"store_id":5246,"store_name":"Shop","name":["' || p_name || '","other"],"url":["' || {url} || '","' || {url} || '/b"],"image":["i0.jpg","i1.jpg"],"color":["red"," blue "],"price":["' || {price} || '.50",{{{{"amount":"12","currency":"USD"}}}}],"urlToSku":{{{{"' || {url} || '/b":"B' || {k} || '","' || {url} || '":["A' || {k} || '","A' || {k} || 'X"," "]}}}},"brand":["' || p_brand || '"],"rating":"4.5 stars","sku":["A' || {k} || '"]}}}}'
        WHEN 1 THEN '{{{{"store_id":" 77 ","name":" ' || p_name || ' ","product_url":"' || {url} || '","image_url":"p.png","offers":[{{{{"price":{{{{"amount":99,"currency":"EUR"}}}},"sku":"O' || {k} || '","url":"' || {url} || '?variant=40000' || {k} || '"}}}},{{{{"price":1250,"sku":"O' || {k} || 'B"}}}},{{{{"price":"5","url":"x"}}}}],"gtin":["00' || {k} || '",""],"category":["' || p_type || '"],"rating":[3,"x"]}}}}'
        WHEN 2 THEN '{{{{"store_id":"","name":"' || p_name || '","page_url":"' || {url} || '","image_url_list":["l.png"],"offer_list":[{{{{"offer_amount":"' || {price} || '.99","offer_currency":"USD","offer_sku":"L' || {k} || '"}}}},{{{{"offer_amount":1500,"offer_sku":"L' || {k} || 'B"}}}},{{{{"offer_amount":12.5,"offer_sku":"L' || {k} || '"}}}}],"brand_list":["' || p_brand || '"],"breadcrumbs":"a > b"}}}}'
        WHEN 3 THEN '{{{{"store_id":5246,"name":"' || p_name || '","canonical":["' || {url} || '.html"],"url":"https://www.target.com/p/x/-/A-' || cast(10000000 + l_partkey as string) || '","sku":["S' || {k} || '","S' || {k} || 'B"],"sku_list":["S' || {k} || '"],"image":["i0.jpg"],"color_list":["' || {_COLOR} || '","green"],"price":[1999.6,"15"],"priceCurrency":["GBP"],"mpn_list":["M' || {k} || '"],"productID":["P' || {k} || '"],"productid_list":["P' || {k} || '"]}}}}'
        WHEN 4 THEN '{{{{"name":"","url":"  ","priceInCents":["123","9"],"priceCurrency":["USD"],"description":["d1","d2"],"priceToSku":{{{{"12.5":"Z' || {k} || '","13":["Y' || {k} || '"]}}}}' || '}}}}'
        WHEN 5 THEN '{{{{"store_id":[1],"name":7,"sku":"notalist","url":"' || {url} || '"}}}}'
        ELSE '{{{{"store_id":null,"name":"' || p_name || '","url":"not a url","price":["free"],"rating":4,"created_ts":"' || cast(l_orderkey as string) || '"}}}}'
      END AS raw
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""".replace("{{{{", "{{").replace("}}}}", "}}")


def _with_broken(events: str) -> str:
    """Every eleventh event or so can't be read: cut off, no object, empty or missing."""
    return f"""
    SELECT event_id, CASE length(event_id || raw) % 44 WHEN 3 THEN substr(raw, 1, length(raw) - 1) WHEN 14 THEN '[1,2]' WHEN 25 THEN '' WHEN 36 THEN NULL ELSE raw END AS raw
    FROM ({events}) whole"""


def mixed_views(d: Dialect) -> str:
    return _with_broken(raw_views(d))


def mixed_carts(d: Dialect) -> str:
    return _with_broken(raw_carts(d))


def raw_carts(d: Dialect) -> str:
    """Raw cart events as JSON text: one event per line item with up to four product entries."""
    url = "'https://www.shop.example.com/product/prod-' || cast(100000 + l_partkey as string)"
    cents = "cast(cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) as string)"
    first = f"""'{{"name":"' || p_name || '","url":"' || {url} || '","image_url":"https://img.example.com/SK' || cast(100000 + l_partkey as string) || '_a.jpg","item_price":' || {cents} || ',"quantity":' || cast(cast(l_quantity as bigint) as string) || '}}'"""
    text = f"""
    SELECT l_orderkey || '-' || {_POS} AS event_id, l_orderkey AS session_id,
      cast(l_linenumber as bigint) AS created_ts,
      CASE l_partkey % 5
        WHEN 0 THEN '{{"store_id":5246,"created_ts":"' || cast(l_linenumber as string) || '","cart_total":100,"product_list":[' || {first} || ',{{"name":"again","url":"' || {url} || '","quantity":9}},{{"name":"free","item_price":0}},{{"name":"no price"}}]}}'
        WHEN 1 THEN '{{"store_id":" 12 ","product_list":[{{"url":"  ","name":"blank url","item_price":5}},' || {first} || ']}}'
        WHEN 2 THEN '{{"store_id":"7","created_ts":"x","product_list":[]}}'
        WHEN 3 THEN '{{"store_id":"8"}}'
        ELSE '{{"product_list":[{{"url":"not a url","line_total":250}},{{"url":"https://www.target.com/p/x/-/A-' || cast(10000000 + l_partkey as string) || '","name":" "}}]}}'
      END AS raw
    FROM [[lineitem]] JOIN [[part]] ON l_partkey = p_partkey"""
    return text.replace("[[", "\0").replace("]]", "\1").replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")


def session_views(d: Dialect) -> str:
    """Flat session views for the reports: one view per row with colours, SKUs and a dollar amount as text."""
    return f"""
    SELECT l_orderkey AS session_id, {_POS} AS view_pos, cast(l_orderkey % 50 as string) AS store_id,
      CASE WHEN l_orderkey % 31 = 3 AND l_partkey % 2 = 0 THEN 'Second' ELSE 'Shop ' || cast(l_orderkey % 50 as string) END AS store_name,
      p_name AS name,
      CASE WHEN l_partkey % 19 = 4 THEN NULL WHEN l_partkey % 19 = 5 THEN 'broken url'
        WHEN l_partkey % 3 = 0 THEN 'https://www.shop.example.com/p/' || cast(100000 + l_partkey as string)
        WHEN l_partkey % 3 = 1 THEN 'https://Shop.example.com/item/AB-' || cast(100000 + l_partkey as string) || '?colorid=' || cast(1000 + l_partkey as string)
        ELSE 'http://www.store.example.com/browse?sku=SK' || cast(100000 + l_partkey as string) END AS url,
      CASE WHEN l_partkey % 2 = 0 THEN {d.arr(_COLOR, "'teal'")} END AS color_list,
      CASE WHEN l_partkey % 10 < 4 THEN {d.arr(_SKU, "cast(100000 + l_partkey as string)")} WHEN l_partkey % 10 = 4 THEN {_empty(d)} END AS sku_list,
      CASE WHEN l_partkey % 17 = 6 THEN 'n/a' ELSE cast(cast(p_retailprice as decimal(12,2)) as string) END AS amount
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
    WHERE (l_partkey + l_suppkey) % 3 <> 0"""


def session_cart_items(d: Dialect) -> str:
    """Lines of the sessions' cart events: ``cart_ts`` (as text) and ``cart_pos`` order the events of a session."""
    return f"""
    SELECT l_orderkey AS session_id, {_POS} AS item_pos, cast(floor(l_linenumber / 3) as bigint) AS cart_pos,
      CASE WHEN l_orderkey % 5 = 2 THEN NULL ELSE cast(cast(100 - floor(l_linenumber / 3) * (l_orderkey % 3) as bigint) as string) END AS cart_ts,
      cast(l_orderkey % 50 as string) AS store_id, 'Shop ' || cast(l_orderkey % 50 as string) AS store_name, {_CART_TITLE} AS name,
      CASE WHEN l_partkey % 4 = 0 THEN NULL
        WHEN l_partkey % 3 = 0 THEN 'https://www.shop.example.com/p/' || cast(100000 + l_partkey as string) || '/'
        WHEN l_partkey % 3 = 1 THEN 'https://shop.example.com/item/AB-' || cast(100000 + l_partkey as string)
        ELSE 'http://www.store.example.com/browse?skuid=SK' || cast(100000 + l_partkey as string) || '&color=x' END AS url,
      {_CART_IMAGE} AS image_url,
      cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) AS item_price,
      cast(l_quantity as bigint) AS quantity,
      cast(floor(l_extendedprice * 100 + 0.5) as bigint) AS line_total
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""


def known_golden(d: Dialect) -> str:
    """URLs the golden set already has."""
    return """
    SELECT 'https://www.shop.example.com/p/' || cast(100000 + p_partkey as string) AS url FROM {part} WHERE p_partkey % 6 = 0"""


def jsonld_docs(d: Dialect) -> str:
    """Schema.org documents with nested offers, variants and models, some not products."""
    k = "cast(p_partkey as string)"
    deep = f"""'"sku":"N8' || {k} || '"'"""
    for i in reversed(range(8)):
        deep = f"""'"sku":"N{i}' || {k} || '","{("offers", "hasVariant", "model")[i % 3]}":' || chr(123) || {deep} || chr(125)"""
    text = f"""
    SELECT p_partkey AS doc_id,
      CASE p_partkey % 9
        WHEN 0 THEN '{{"@context":"https://schema.org","@type":"Product","name":"' || p_name || '","sku":"A' || {k} || '","brand":{{"name":"' || p_brand || '"}},"offers":[{{"sku":"B' || {k} || '"}},{{"sku":["C' || {k} || '","A' || {k} || '",5],"offers":{{"sku":"D' || {k} || '"}}}}]}}'
        WHEN 1 THEN '{{"@context":"http://schema.org","@type":["Thing","Product"],"name":"' || p_name || '","brand":"' || p_brand || '","hasVariant":[{{"sku":"V1' || {k} || '","offers":{{"sku":"V2' || {k} || '"}}}},{{"sku":"V3' || {k} || '","isVariantOf":{{"sku":"V4' || {k} || '"}}}}],"model":"M' || {k} || '"}}'
        WHEN 2 THEN '{{"@context":"https://schema.org","@type":"Product","name":"","sku":"E' || {k} || '"}}'
        WHEN 3 THEN '{{"@type":"Offer","name":"' || p_name || '"}}'
        WHEN 4 THEN '{{"@context":"https://schema.org","@type":"Product","name":"' || p_name || '","description":"d","model":[{{"sku":"W' || {k} || '","model":{{"sku":"X' || {k} || '"}}}}],"offers":{{"hasVariant":{{"isVariantOf":{{"model":{{"offers":[{{"sku":"Y' || {k} || '"}}]}}}}}}}}}}'
        WHEN 5 THEN '[{{"@context":"https://schema.org","@type":"Product","name":"x","sku":"Z' || {k} || '"}}]'
        WHEN 6 THEN CASE WHEN p_partkey % 2 = 0 THEN '{{"@context":"https://schema.org","@type":"Product","name":"deep",' || {deep} || '}}' ELSE '{{"@context":"https://schema.org","@type":"Product","name":5,"sku":7}}' END
        WHEN 7 THEN '{{"@context":"https://schema.org","@graph":[{{"@type":"Product","name":"g","sku":"G' || {k} || '"}}],"@type":"WebPage","name":"g"}}'
        ELSE '{{"@context":"https://schema.org","@type":"Product","name":"' || p_name || '","sku":["S' || {k} || '","S' || {k} || '","T"],"isVariantOf":[{{"hasVariant":[{{"sku":"T"}},{{"sku":"U' || {k} || '"}}]}}]}}'
      END AS json
    FROM [[part]]"""
    return text.replace("[[", "\0").replace("]]", "\1").replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")


def asin_requests(d: Dialect) -> str:
    return """
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
      CASE WHEN l_partkey % 50 = 49 THEN '' ELSE 'B' || lpad(cast(l_partkey as string), 9, '0') END AS asin
    FROM {lineitem}"""


def asin_mapping(d: Dialect) -> str:
    """Lookup results per ASIN; an ASIN can list several products and some only report that nothing was found."""
    return """
    SELECT 'B' || lpad(cast(p_partkey as string), 9, '0') AS asin, v.product_pos,
      CASE WHEN p_partkey % 6 = 5 THEN 'product_not_found' WHEN p_partkey % 6 = 4 THEN 'quota' END AS error_id,
      CASE WHEN p_partkey % 6 = 4 THEN 'Quota exceeded' END AS error_title,
      CASE WHEN p_partkey % 2 = 0 THEN '0' || cast(p_partkey * 10 + v.product_pos as string) ELSE '' END AS upc,
      CASE WHEN p_partkey % 3 = 0 THEN 'SK' || cast(p_partkey * 10 + v.product_pos as string) END AS sku,
      CASE WHEN v.product_pos = 0 THEN 'M' || cast(p_partkey as string) END AS mpn
    FROM {part} CROSS JOIN (SELECT cast(0 as bigint) AS product_pos UNION ALL SELECT cast(1 as bigint)) v
    WHERE p_partkey % 7 <> 3 AND (v.product_pos = 0 OR p_partkey % 4 = 0)"""


def fetch_log(d: Dialect) -> str:
    """Image downloads: request, response status, headers and stored size."""
    return """
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
      cast(l_suppkey as string) AS store_id,
      'https://www.shop.example.com/p/' || cast(l_partkey as string) AS product_url,
      CASE WHEN l_partkey % 29 = 3 THEN 'ftp://img.example.com/a.png' WHEN l_partkey % 29 = 4 THEN 'nothing'
        ELSE 'https://IMG' || cast(l_suppkey % 5 as string) || '.example.com/' || cast(l_partkey as string) || '.tif' END AS image_url,
      CASE WHEN l_linenumber < 4 THEN 200 WHEN l_linenumber = 4 THEN 429 WHEN l_linenumber = 5 THEN 404
        WHEN l_linenumber = 6 THEN 503 ELSE 415 END AS status,
      CASE l_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'IMAGE/PNG; charset=x' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/gif'
        WHEN 4 THEN NULL ELSE 'image/jpeg ; q=1' END AS content_type,
      CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE cast(cast(l_quantity as bigint) * 300 as string) END AS content_length,
      cast(l_extendedprice * 300 as bigint) AS size_bytes,
      CASE l_partkey % 3 WHEN 0 THEN '120' WHEN 1 THEN 'Wed, 21 Oct 2099 07:28:00 GMT' END AS retry_after,
      timestamp '2099-10-21 07:00:00' AS fetched_at
    FROM {lineitem}"""


def suffix_list(d: Dialect) -> str:
    """A public suffix list with a rule per customer, of each kind and up to three labels, and some lines that are none."""
    k = "cast(c_custkey {} as string)".format
    return f"""
    SELECT CASE c_custkey % 10 WHEN 0 THEN '*.w' || {k('')} || '.test' WHEN 1 THEN '!city.w' || {k('- 1')} || '.test' WHEN 2 THEN 'C' || {k('')} || '.d.e  as of today'
        WHEN 3 THEN '// c' || {k('')} || '.f' ELSE 'c' || {k('')} || '.r' || cast(c_custkey % 7 as string) END AS rule
    FROM {{customer}} UNION ALL SELECT rule FROM (VALUES ('co.uk'), ('com.au'), (''), ('*'), ('blogspot.com')) AS fixed(rule)"""


def suffix_hosts(d: Dialect) -> str:
    """URLs whose hosts end in the list's suffixes, are suffixes themselves, or have too few or many labels; one per customer and form."""
    k = "cast(c_custkey {} as string)".format
    of = f"""CASE c_custkey % 10 WHEN 0 THEN 'w' || {k('')} || '.test' WHEN 1 THEN 'city.w' || {k('- 1')} || '.test' WHEN 2 THEN 'c' || {k('')} || '.d.e' ELSE 'c' || {k('')} || '.r' || cast(c_custkey % 7 as string) END"""
    return f"""
    SELECT c_custkey, form, 'https://' || CASE form WHEN 0 THEN {of} WHEN 1 THEN 'Shop.' || {of} WHEN 2 THEN 'a.b.' || {of} WHEN 3 THEN 'gap.x.y.' || {of} WHEN 4 THEN 'www.example.co.uk'
        ELSE '10.0.' || cast(c_custkey % 200 as string) || '.1' END || '/p/' || {k('')} AS url
    FROM {{customer}} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS forms(form)"""


ADAPTERS = {
    "registry_snapshots": registry_snapshots,
    "store_visits": store_visits,
    "suffix_list": suffix_list,
    "suffix_hosts": suffix_hosts,
    "product_urls": product_urls,
    "golden_urls": golden_urls,
    "cart_lines": cart_lines,
    "viewed_products": viewed_products,
    "store_registry": store_registry,
    "url_log": url_log,
    "store_catalog": store_catalog,
    "raw_views": raw_views,
    "raw_carts": raw_carts,
    "mixed_views": mixed_views,
    "mixed_carts": mixed_carts,
    "session_views": session_views,
    "session_cart_items": session_cart_items,
    "known_golden": known_golden,
    "jsonld_docs": jsonld_docs,
    "asin_requests": asin_requests,
    "asin_mapping": asin_mapping,
    "fetch_log": fetch_log,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that comes in fewer splits than there are cores is spread before the per-row work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("lineitem", "orders", "events", "part", "pages") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as DataFrame."""
    text = ADAPTERS[name](SPARK)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


#: What the inputs of sessions are made from; all of them come from the same rows.
SESSION_ROWS = "{lineitem} JOIN {part} ON l_partkey = p_partkey"


def session_views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Derived inputs of sessions, as ``view`` gives them, over one copy of their rows in buckets of the session.

    The rows are written before they are widened to titles, URLs and lists, so what moves is a few numbers and texts a row.
    """
    texts = [ADAPTERS[n](SPARK) for n in names]
    if missing := [n for n, t in zip(names, texts, strict=True) if SESSION_ROWS not in t]:
        raise ValueError(f"not made from the rows of sessions: {missing}")
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    used = [c for c in (*lines.columns, *parts.columns) if any(c in t for t in texts)]
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(*used)
    rows = bucketed(rows, "l_orderkey", "session-rows", lines.count())
    return [rows.sparkSession.sql(t.replace(SESSION_ROWS, "{rows}"), rows=rows) for t in texts]


def view_sql(name: str) -> str:
    """The same input as SQL text over the registered tables of the checking engine."""
    return ADAPTERS[name](DUCKDB).format(**{t: t for t in TABLES})
