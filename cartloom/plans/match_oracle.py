"""The matching queries as plain SQL: every strategy as its own nested comparison, nothing shared with the key join."""

from __future__ import annotations

from cartloom.plans.adapters import view_sql

_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', ' ', 'g'))".format
_WORDS = "list_distinct(CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ' ') END)".format
_PAIRS = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))".format


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def similarity(a: str, b: str) -> str:
    head = f"CASE WHEN length({a}) <= length({b}) THEN starts_with({b}, {a} || ' ') ELSE starts_with({a}, {b} || ' ') END"
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {head} THEN 0.95
        ELSE greatest({_dice(_WORDS(a), _WORDS(b))}, {_dice(_PAIRS(a), _PAIRS(b))}, {_lev(a, b)}) END"""


_URL = "nullif(regexp_replace(lower({0}), '/+$', ''), '')".format
_CMP = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))".format
_COLON = "'^(.+?)\\s+([A-Za-z]+(?:\\s+[A-Z0-9]+)?)\\s*:-\\s*.+$'"

BASE = f"""c0 AS ({view_sql("cart_lines")}), p AS ({view_sql("viewed_products")}),
    c1 AS (SELECT *, {_URL('url')} AS nurl, coalesce(regexp_extract_all(split_part(image_url, '/', -1), '([A-Z][A-Z0-9]{{3,9}})[-_.]', 1), []) AS image_skus,
      regexp_matches(title, {_COLON}) AS colon, regexp_split_to_array(title, '\\s+[-–—]\\s+') AS parts, {_NORM('title')} AS ntitle FROM c0),
    c AS (SELECT *, {_CMP(f"CASE WHEN colon THEN regexp_extract(title, {_COLON}, 1) WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], ' - ') ELSE title END")} AS base,
      {_CMP(f"CASE WHEN colon THEN regexp_extract(title, {_COLON}, 2) WHEN len(parts) > 1 THEN parts[len(parts)] END")} AS color FROM c1),
    pv AS (SELECT session_id, product_pos, title, unnest(range(0, len(variants))) AS variant_pos, unnest(variants) AS v FROM p),
    cs AS (SELECT session_id, item_pos, unnest(skus) AS k FROM c), ci AS (SELECT session_id, item_pos, unnest(image_skus) AS k FROM c),
    ce AS (SELECT session_id, item_pos, unnest(extracted_ids) AS k FROM c),
    ps AS (SELECT session_id, product_pos, unnest(skus) AS k FROM p), pe AS (SELECT session_id, product_pos, unnest(extracted_ids) AS k FROM p),
    pve AS (SELECT session_id, product_pos, variant_pos, unnest(v.extracted_ids) AS k FROM pv)"""

_P = "{{'product_pos': p.product_pos, 'level': {0}, 'variant_pos': {1}}}".format
_PRODUCT, _VARIANT = _P(0, "cast(NULL AS bigint)"), _P(1, "p.variant_pos")


def _join(cart: str, product: str, on: str, hit: str) -> str:
    return f"SELECT c.session_id, c.item_pos, {hit} AS hit FROM {cart} c JOIN {product} p ON c.session_id = p.session_id AND {on}"


HITS = {
    "sku": _join("cs", "ps", "c.k = p.k", _PRODUCT),
    "variant_sku": _join("cs", "pv", "c.k = p.v.sku", _VARIANT),
    "image_sku": _join("ci", "ps", "c.k = p.k", _PRODUCT),
    "extracted_id_sku": _join("ce", "ps", "c.k = p.k", _PRODUCT) + " UNION ALL " + _join("ce", "pv", "c.k = p.v.sku", _VARIANT),
    "url": _join("c", "p", f"c.nurl = {_URL('p.url')}", _PRODUCT) + " UNION ALL " + _join("c", "pv", f"c.nurl = {_URL('p.v.url')}", _VARIANT),
    "extracted_id": _join("ce", "pe", "c.k = p.k", _PRODUCT) + " UNION ALL " + _join("ce", "pve", "c.k = p.k", _VARIANT),
    "title_color": _join("c", "p", f"c.base <> '' AND c.color <> '' AND c.base = {_CMP('p.title')} AND c.color = {_CMP('p.color')}", _PRODUCT)
    + " UNION ALL "
    + _join("c", "pv", f"c.base <> '' AND c.color <> '' AND c.base = {_CMP('p.title')} AND c.color = {_CMP('p.v.color')}", _VARIANT),
}
CONFIDENCE = {"sku": "high", "variant_sku": "high", "image_sku": "high", "extracted_id_sku": "high", "url": "medium", "extracted_id": "medium", "title_color": "medium", "title": "low"}

_TITLE = f"""tpairs AS (SELECT DISTINCT c.ntitle AS a, {_NORM('p.title')} AS b FROM c JOIN p ON c.session_id = p.session_id WHERE c.title <> '' AND p.title <> ''),
    tscore AS (SELECT a, b, {similarity('a', 'b')} AS score FROM tpairs),
    h_title AS (SELECT session_id, item_pos, {{'product_pos': arg_min(product_pos, {{'s': -score, 'p': product_pos}}), 'level': 0, 'variant_pos': cast(NULL AS bigint)}} AS hit
      FROM (SELECT c.session_id, c.item_pos, p.product_pos, t.score FROM c JOIN p ON c.session_id = p.session_id JOIN tscore t ON t.a = c.ntitle AND t.b = {_NORM('p.title')} WHERE t.score >= 0.8)
      GROUP BY session_id, item_pos)"""


def _hit_cte(method: str) -> str:
    if method == "title":
        return _TITLE
    return f"h_{method} AS (SELECT session_id, item_pos, arg_min(hit, {{'p': hit.product_pos, 'l': hit.level, 'v': coalesce(hit.variant_pos, -1)}}) AS hit FROM ({HITS[method]}) GROUP BY session_id, item_pos)"


def _strategy(method: str) -> str:
    exact = "false" if method == "title" else "true"
    return f"""WITH {BASE}, {_hit_cte(method)} SELECT session_id, item_pos, hit.product_pos AS product_pos, hit.variant_pos AS variant_pos, '{method}' AS method, '{CONFIDENCE[method]}' AS confidence, {exact} AS exact FROM h_{method}"""


_ALL = ", ".join(_hit_cte(m) for m in CONFIDENCE)
_JOINS = " ".join(f"LEFT JOIN h_{m} ON h_{m}.session_id = c.session_id AND h_{m}.item_pos = c.item_pos" for m in CONFIDENCE)
_FIRST = "CASE " + " ".join(f"WHEN h_{m}.hit IS NOT NULL THEN '{m}'" for m in CONFIDENCE) + " END"
_CLOSE = "({0} = {1} OR ({0} <> 0 AND {1} <> 0 AND abs({0} - {1}) / greatest({0}, {1}) <= 0.1))".format
_SIGNALS = ", ".join(f"CASE WHEN h_{m}.hit IS NOT NULL THEN '{m}:{CONFIDENCE[m]}:{'false' if m == 'title' else 'true'}' END" for m in CONFIDENCE)

PRIMARY = f"""{BASE}, {_ALL},
    pr0 AS (SELECT c.*, coalesce({", ".join(f"h_{m}.hit" for m in CONFIDENCE)}) AS hit, {_FIRST} AS method,
        list_filter([{_SIGNALS}], lambda x: x IS NOT NULL) AS sig FROM c {_JOINS}),
    pr AS (SELECT pr0.*, CASE WHEN method IN ('sku', 'variant_sku', 'image_sku', 'extracted_id_sku') THEN 'high' WHEN method = 'title' THEN 'low' WHEN method IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence,
        q AS p, list_filter(q.variants, lambda v: {_CLOSE('pr0.price', 'v.price')}) AS close_variants
      FROM pr0 LEFT JOIN p AS q ON q.session_id = pr0.session_id AND q.product_pos = pr0.hit.product_pos),
    prim AS (SELECT *, CASE WHEN {_CLOSE('price', 'p.price')} THEN price = p.price WHEN len(close_variants) > 0 THEN price = close_variants[1].price END AS price_exact FROM pr),
    primary_lines AS (SELECT *, array_to_string(CASE WHEN price_exact IS NULL THEN sig ELSE list_append(sig, 'price:low:' || price_exact) END, '|') AS signals FROM prim)"""

GUARD = """guard AS (SELECT session_id, a AS cart_store_id, b AS product_store_id, 'Store ID mismatch: cart storeId "' || a || '" does not match product storeId "' || b || '"' AS message
    FROM (SELECT session_id, arg_min(store_id, item_pos) AS a FROM c0 GROUP BY 1) JOIN (SELECT session_id, arg_min(store_id, product_pos) AS b FROM p GROUP BY 1) USING (session_id) WHERE a <> b)"""


def enriched(level: str = "low") -> str:
    keep = {"low": "method IS NOT NULL", "medium": "confidence IN ('high', 'medium')", "high": "confidence = 'high'"}[level]
    either = "list_concat(coalesce({0}, []), list_filter(coalesce(p.{0}, []), lambda x: NOT list_contains(coalesce({0}, []), x)))".format
    ids = ", ".join(f"CASE WHEN w THEN array_to_string({either(k)}, '|') ELSE array_to_string({k}, '|') END AS ids_{k}" for k in ("product_ids", "extracted_ids", "skus", "gtins", "mpns"))
    return f"""{PRIMARY}, {GUARD},
    kept AS (SELECT *, {keep} AS w FROM primary_lines WHERE session_id NOT IN (SELECT session_id FROM guard)),
    cut AS (SELECT * EXCLUDE (p, hit), CASE WHEN w THEN p END AS p, CASE WHEN w THEN hit END AS hit, CASE WHEN w THEN p.variants[hit.variant_pos + 1] END AS v FROM kept),
    enriched AS (SELECT session_id, item_pos, coalesce(title, p.title) AS title, coalesce(url, p.url) AS url, coalesce(image_url, v.image_url, p.image_url) AS image_url, store_id, price, quantity, line_total,
      coalesce(p.currency, v.currency) AS currency, p.brand AS brand, p.description AS description, p.category AS category, p.rating AS rating, w AS was_viewed,
      CASE WHEN w THEN confidence ELSE 'none' END AS match_confidence, CASE WHEN w THEN method END AS match_method, hit.product_pos AS product_pos, CASE WHEN w THEN signals ELSE '' END AS matched_signals, v,
      CASE WHEN title IS NOT NULL THEN 'cart' WHEN p.title IS NOT NULL THEN 'product' END AS from_title, CASE WHEN url IS NOT NULL THEN 'cart' WHEN p.url IS NOT NULL THEN 'product' END AS from_url,
      CASE WHEN image_url IS NOT NULL THEN 'cart' WHEN v.image_url IS NOT NULL OR p.image_url IS NOT NULL THEN 'product' END AS from_image_url, CASE WHEN price IS NOT NULL THEN 'cart' END AS from_price,
      {", ".join(f"CASE WHEN p.{f} IS NOT NULL THEN 'product' END AS from_{f}" for f in ("brand", "description", "category", "rating"))}, CASE WHEN w THEN 'merged' ELSE 'cart' END AS from_ids, {ids} FROM cut)"""


_E = f"WITH {enriched()} SELECT "
_FUNCTION = f"""WITH {BASE}, pairs AS (SELECT DISTINCT c.ntitle AS a, {_NORM('p.title')} AS b FROM c JOIN p ON c.session_id = p.session_id AND c.item_pos = p.product_pos) SELECT a, b, """

ORACLE: dict[str, str] = {
    **{f"match_{m}": _strategy(m) for m in CONFIDENCE},
    "signal_price": f"WITH {PRIMARY} SELECT session_id, item_pos, price_exact FROM primary_lines WHERE method IS NOT NULL AND price_exact IS NOT NULL",
    "title_normalize": f"WITH {BASE} SELECT DISTINCT title, ntitle AS normalized FROM c",
    "token_dice": _FUNCTION + f"round({_dice(_WORDS('a'), _WORDS('b'))}, 6) AS token_dice FROM pairs",
    "bigram_dice": _FUNCTION + f"round({_dice(_PAIRS('a'), _PAIRS('b'))}, 6) AS bigram_dice FROM pairs",
    "levenshtein_similarity": _FUNCTION + f"round({_lev('a', 'b')}, 6) AS levenshtein_similarity FROM pairs",
    "title_similarity": _FUNCTION + f"round({similarity('a', 'b')}, 6) AS score FROM pairs",
    "match_signals": f"WITH {PRIMARY} SELECT session_id, item_pos, signals FROM primary_lines WHERE method IS NOT NULL",
    "match_primary": f"WITH {PRIMARY} SELECT session_id, item_pos, method, confidence, hit.product_pos AS product_pos, hit.variant_pos AS variant_pos FROM primary_lines WHERE method IS NOT NULL",
    "match_threshold": " UNION ALL ".join(
        f"SELECT * FROM (WITH {enriched(level)} SELECT was_viewed, match_confidence, match_method, count(*) AS items, '{level}' AS min_confidence FROM enriched GROUP BY 1, 2, 3)" for level in ("high", "medium", "low")
    ),
    "merge_fields": _E + "session_id, item_pos, title, url, image_url, price, currency, brand, description, category, rating FROM enriched",
    "field_provenance": _E + "session_id, item_pos, " + ", ".join(f"from_{f}" for f in ("title", "url", "image_url", "price", "brand", "description", "category", "rating", "ids")) + " FROM enriched",
    "merge_ids": _E + "session_id, item_pos, " + ", ".join(f"ids_{k} AS {k}" for k in ("product_ids", "extracted_ids", "skus", "gtins", "mpns")) + " FROM enriched",
    "matched_variant": _E + "session_id, item_pos, " + ", ".join(f"v.{f} AS {f}" for f in ("sku", "url", "image_url", "price", "currency", "color")) + " FROM enriched WHERE v IS NOT NULL",
    "enrich_cart": f"WITH {enriched('high')} SELECT session_id, item_pos, title, url, store_id, price, quantity, line_total, brand, currency, was_viewed, match_confidence, match_method, product_pos, matched_signals, ids_skus AS skus, v.sku AS variant_sku FROM enriched",
    "enrichment_summary": _E
    + "session_id, count(*) AS total_items, count(*) FILTER (was_viewed) AS matched_items, count(*) FILTER (NOT was_viewed) AS unmatched_items, "
    + ", ".join(f"count(*) FILTER (match_confidence = '{c}') AS confidence_{c}" for c in ("none", "low", "medium", "high"))
    + ", "
    + ", ".join(f"count(*) FILTER (match_method = '{m}') AS method_{m}" for m in [*CONFIDENCE, "price"])
    + ", round(count(*) FILTER (was_viewed) * 100.0 / count(*), 6) AS match_rate FROM enriched GROUP BY session_id",
    "enrichment_totals": _E
    + "'confidence' AS dimension, match_confidence AS value, count(*) AS items FROM enriched GROUP BY match_confidence UNION ALL SELECT 'method', coalesce(match_method, 'none'), count(*) FROM enriched GROUP BY match_method",
    "store_mismatch_guard": f"WITH {BASE}, {GUARD} SELECT * FROM guard",
    "unmatched_cart_lines": _E + "session_id, item_pos, title FROM enriched WHERE NOT was_viewed",
}
