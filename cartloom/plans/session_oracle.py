"""The session reports as plain SQL, by nested comparison inside each session."""

from __future__ import annotations

from cartloom.plans.adapters import view_sql
from cartloom.plans.url_oracle import ALL_URLS, NON_PRODUCT_RULES, parts_sql, shape_sql, text


def mined_sql(src: str, url: str = "url") -> str:
    """Mining normalisation of any source with a URL column."""
    full = f"SELECT *, CASE WHEN regexp_matches(trim({url}), '^(?i)https?://') THEN trim({url}) ELSE 'https://' || trim({url}) END AS full_url FROM ({src}) f0"
    return f"""
    SELECT *, CASE WHEN m_err IS NULL THEN sch || '://' || host || m_path || substr(u, length(split_part(split_part(u, '#', 1), '?', 1)) + 1) ELSE lower(trim({url})) END AS m_url
    FROM (SELECT * EXCLUDE (err), err AS m_err, CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(lower(path), '/$', '') ELSE path END AS m_path
    FROM ({parts_sql(full, "full_url")}) m1) m2"""


_DROP = "* EXCLUDE (u, sch, main, rest, q, authority, path, host, port, m_err, m_path, m_url, full_url, segs, in_path, in_q, pid, ex, fresh, id_location, id_format, id_confidence, id_from_end, id_param, id_prefix, id_description, shape_ids)"


def with_ids(src: str) -> str:
    return f"SELECT {_DROP}, CASE WHEN url IS NULL THEN [] ELSE shape_ids END AS url_ids FROM ({shape_sql(mined_sql(src))})"


_IMAGE = "coalesce(regexp_extract_all(split_part(image_url, '/', -1), '([A-Z][A-Z0-9]{3,9})[-_.]', 1), [])"
_COLON = "'^(.+?)\\s+([A-Za-z]+(?:\\s+[A-Z0-9]+)?)\\s*:-\\s*.+$'"
_URLKEY = "nullif(regexp_replace(lower({0}), '/+$', ''), '')".format
_NUM = "try_cast(regexp_extract(amount, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS double)"

BASE = f"""v AS MATERIALIZED ({with_ids(view_sql("session_views"))}), items AS ({view_sql("session_cart_items")}),
    fin0 AS (SELECT * EXCLUDE (last_pos) FROM (SELECT *, max(cart_pos) OVER (PARTITION BY session_id) AS last_pos FROM items) WHERE cart_pos = last_pos),
    fin AS MATERIALIZED (SELECT *, {_IMAGE} AS image_skus, CASE WHEN colon THEN trim(regexp_extract(name, {_COLON}, 1)) WHEN len(parts) > 1 THEN trim(array_to_string(parts[1:len(parts) - 1], ' - ')) ELSE trim(name) END AS base,
        CASE WHEN colon THEN trim(regexp_extract(name, {_COLON}, 2)) WHEN len(parts) > 1 THEN trim(parts[len(parts)]) END AS color
      FROM (SELECT *, regexp_matches(name, {_COLON}) AS colon, regexp_split_to_array(name, '\\s+[-–—]\\s+') AS parts FROM ({with_ids("SELECT * FROM fin0")}))),
    vals AS MATERIALIZED (SELECT DISTINCT session_id, lower(url) AS url_key, 'color' AS kind, unnest(color_list) AS value FROM v WHERE url IS NOT NULL
      UNION ALL SELECT DISTINCT session_id, lower(url), 'sku', unnest(sku_list) FROM v WHERE url IS NOT NULL
      UNION ALL SELECT DISTINCT session_id, lower(url), 'url_id', unnest(url_ids) FROM v WHERE url IS NOT NULL),
    up AS MATERIALIZED (SELECT session_id, lower(url) AS url_key, min(view_pos) AS first_pos, arg_min(name, view_pos) AS name, arg_min(url, view_pos) AS url, count(*) AS view_count,
        min({_NUM}) AS price_min, max({_NUM}) AS price_max FROM v WHERE url IS NOT NULL GROUP BY ALL),
    sizes AS (SELECT session_id, url_key, count(*) FILTER (kind = 'color') AS colors, count(*) FILTER (kind = 'sku') AS skus, count(*) FILTER (kind = 'url_id') AS extracted_ids FROM vals GROUP BY ALL),
    ups AS (SELECT up.*, coalesce(colors, 0) AS colors, coalesce(skus, 0) AS skus, coalesce(extracted_ids, 0) AS extracted_ids FROM up LEFT JOIN sizes USING (session_id, url_key)),
    sk AS (SELECT session_id, first_pos, up.name, kind, value FROM vals JOIN up USING (session_id, url_key))"""

_EACH = "SELECT f.session_id, f.item_pos, '{0}' AS strategy, {1} AS first_pos FROM (SELECT session_id, item_pos, {2} AS k, base, color, name, item_price FROM fin) f JOIN {3} p ON f.session_id = p.session_id AND {4}"


def _each(strategy: str, keys: str, table: str, on: str) -> str:
    return _EACH.format(strategy, "p.first_pos", keys, table, on)


HITS = f"""hits AS MATERIALIZED (
    {_each('image_sku', 'unnest(image_skus)', 'sk', "p.kind = 'sku' AND p.value = f.k")}
    UNION ALL {_each('extracted_id_sku', 'unnest(url_ids)', 'sk', "p.kind = 'sku' AND p.value = f.k")}
    UNION ALL {_each('url', _URLKEY('url'), 'up', f"{_URLKEY('p.url')} = f.k")}
    UNION ALL {_each('extracted_id', 'unnest(url_ids)', 'sk', "p.kind = 'url_id' AND p.value = f.k")}
    UNION ALL {_each('image_id', 'unnest(image_skus)', 'sk', "p.kind = 'url_id' AND p.value = f.k")}
    UNION ALL {_each('title_color', 'color', 'sk', "p.kind = 'color' AND f.base <> '' AND lower(p.name) = lower(f.base) AND lower(p.value) = lower(f.color) AND f.color <> ''")}
    UNION ALL {_each('same_name', 'name', 'up', "lower(p.name) = lower(f.k)")}
    UNION ALL {_each('same_url', 'lower(url)', 'up', "p.url_key = f.k")}
    UNION ALL {_each('title', 'lower(name)', 'up', "(contains(lower(p.name), f.k) OR contains(f.k, lower(p.name)))")}
    UNION ALL {_each('price', 'item_price / 100.0', 'up', "f.k >= p.price_min * 0.9 AND f.k <= p.price_max * 1.1")})"""

_ORDER = ["image_sku", "extracted_id_sku", "url", "extracted_id", "title_color", "title"]
_RANK = "CASE strategy " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_ORDER)) + " END"
PREDICT = f"""{BASE}, {HITS},
    best AS (SELECT session_id, item_pos, arg_min(strategy, {{'p': first_pos, 'r': {_RANK}}}) FILTER ({_RANK} IS NOT NULL) AS predicted,
        {", ".join(f"bool_or(strategy = '{n}') AS s_{n}" for n in [*_ORDER, "price"])} FROM hits WHERE strategy IN ({", ".join(f"'{n}'" for n in [*_ORDER, "price"])}) GROUP BY ALL),
    pred AS (SELECT session_id, item_pos, name, predicted,
        CASE WHEN predicted IN ('image_sku', 'extracted_id_sku') THEN 'high' WHEN predicted IN ('url', 'extracted_id', 'title_color') THEN 'medium' ELSE 'low' END AS confidence,
        predicted IS NOT NULL AS has_view,
        array_to_string(list_filter([{", ".join(f"CASE WHEN s_{n} THEN '{n}' END" for n in [*_ORDER, "price"])}], lambda x: x IS NOT NULL AND x IS DISTINCT FROM predicted), '|') AS alternatives,
        CASE WHEN predicted IS NULL THEN 'no viewed product matches' ELSE 'Matches a viewed product by ' || predicted END AS rationale
      FROM fin LEFT JOIN best USING (session_id, item_pos))"""

QUALITY = f"""{BASE}, vp AS (SELECT session_id, err, sch, sku_list, url FROM ({parts_sql("SELECT session_id, url, sku_list FROM v")})),
    q1 AS (SELECT session_id, count(*) FILTER (coalesce(url, '') = '') AS missing_url, count(*) FILTER (coalesce(len(sku_list), 0) = 0) AS no_skus,
        count(*) FILTER (err IS NOT NULL AND (coalesce(sch, '') IN ('', 'http', 'https'))) AS malformed_url FROM vp GROUP BY 1),
    q2 AS (SELECT session_id, count(*) FILTER (coalesce(url, '') = '') AS cart_line_without_url FROM items GROUP BY 1),
    quality AS (SELECT session_id, coalesce(missing_url, 0) AS missing_url, coalesce(no_skus, 0) AS no_skus, coalesce(malformed_url, 0) AS malformed_url, coalesce(cart_line_without_url, 0) AS cart_line_without_url FROM q1 FULL JOIN q2 USING (session_id))"""

RATES = """r1 AS (SELECT session_id, count(*) AS product_urls, count(*) FILTER (len(url_ids) > 0) AS product_urls_with_ids FROM v GROUP BY 1),
    r2 AS (SELECT session_id, count(*) AS cart_lines, count(*) FILTER (len(url_ids) > 0 OR len(image_skus) > 0) AS cart_lines_with_ids,
      count(*) FILTER (len(url_ids) = 0 AND len(image_skus) = 0 AND coalesce(url, '') <> '') AS cart_urls_without_ids, count(*) FILTER (coalesce(url, '') = '') AS cart_lines_without_url FROM fin GROUP BY 1),
    rates AS (SELECT session_id, coalesce(product_urls, 0) AS product_urls, coalesce(product_urls_with_ids, 0) AS product_urls_with_ids, coalesce(cart_lines, 0) AS cart_lines, coalesce(cart_lines_with_ids, 0) AS cart_lines_with_ids,
      coalesce(cart_urls_without_ids, 0) AS cart_urls_without_ids, coalesce(cart_lines_without_url, 0) AS cart_lines_without_url FROM r1 FULL JOIN r2 USING (session_id))"""
OVERLAP = """o1 AS (SELECT session_id, item_pos, true AS any_hit, bool_or(strategy IN ('extracted_id', 'image_id')) AS id_hit FROM hits WHERE strategy IN ('image_sku', 'extracted_id_sku', 'extracted_id', 'image_id') GROUP BY ALL),
    overlap AS (SELECT session_id, count(*) AS cart_lines, count(*) FILTER (any_hit) AS overlap_ids_or_skus, count(*) FILTER (id_hit) AS overlap_ids FROM fin LEFT JOIN o1 USING (session_id, item_pos) GROUP BY 1)"""
_SPLIT = "list_distinct(regexp_split_to_array({0}, '\\s+'))".format
SIMILAR = f"""sim AS (SELECT f.session_id, f.item_pos, coalesce(max(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9
        ELSE 2.0 * len(list_intersect({_SPLIT('a')}, {_SPLIT('b')})) / (len({_SPLIT('a')}) + len({_SPLIT('b')})) END), 0) AS similarity
      FROM (SELECT session_id, item_pos, trim(lower(name)) AS a FROM fin) f LEFT JOIN (SELECT session_id, trim(lower(name)) AS b FROM up) p ON f.session_id = p.session_id GROUP BY ALL),
    buckets AS (SELECT session_id, count(*) FILTER (similarity >= 0.8) AS will_match, count(*) FILTER (similarity >= 0.6 AND similarity < 0.8) AS borderline, count(*) FILTER (similarity < 0.6) AS wont_match FROM sim GROUP BY 1)"""

_STORE = f"""{BASE}, hostv AS (SELECT session_id, view_pos, regexp_replace(host, '^www\\.', '') AS domain FROM ({parts_sql("SELECT session_id, view_pos, url FROM v")}) WHERE err IS NULL),
    seen AS (SELECT session_id, 'store_id' AS field, store_id AS value, {{'s': 0, 'p': view_pos}} AS seen_at FROM v UNION ALL SELECT session_id, 'store_name', store_name, {{'s': 0, 'p': view_pos}} FROM v
      UNION ALL SELECT session_id, 'domain', domain, {{'s': 0, 'p': view_pos}} FROM hostv
      UNION ALL SELECT session_id, 'store_id', store_id, {{'s': 1, 'p': lpad(cast(cart_pos AS varchar), 12, '0') || '-' || item_pos}} FROM items
      UNION ALL SELECT session_id, 'store_name', store_name, {{'s': 1, 'p': lpad(cast(cart_pos AS varchar), 12, '0') || '-' || item_pos}} FROM items),
    meta AS (SELECT session_id, {", ".join(f"coalesce(arg_min(value, seen_at) FILTER (field = '{f}'), '') AS {f}, count(DISTINCT value) FILTER (field = '{f}') AS {f}_count" for f in ("store_id", "store_name", "domain"))} FROM seen GROUP BY 1)"""

EVOLUTION = """evo AS (SELECT session_id, cart_pos, min(coalesce(try_cast(cart_ts AS bigint), 0)) AS ts, coalesce(min(cart_ts), 'unknown') AS timestamp, count(*) AS item_count, cast(sum(line_total) AS bigint) AS cart_total FROM items GROUP BY ALL)"""

MINED_TITLES = f"""words AS (SELECT *, regexp_split_to_array(name, '\\s+') AS w, nullif(regexp_extract(name, '(?i)\\s*[-–]\\s*([A-Z]{{1,3}}|Small|Medium|Large|\\d+)$', 1), '') AS suffix FROM fin),
    prefixed AS (SELECT session_id, item_pos, suffix, CASE WHEN len(w) >= 2 AND EXISTS (SELECT 1 FROM up p WHERE p.session_id = words.session_id AND NOT starts_with(lower(p.name), lower(w[1]))
        AND contains(lower(p.name), lower(array_to_string(w[2:], ' ')))) THEN w[1] END AS prefix FROM words),
    mined AS (SELECT session_id, item_pos, prefix, suffix FROM prefixed WHERE prefix IS NOT NULL OR suffix IS NOT NULL)"""
IMAGES = """img AS (SELECT session_id, regexp_extract(split_part(image_url, '/', -1), '(\\d{6,12})', 1) AS n, regexp_extract(split_part(image_url, '/', -1), '([a-zA-Z0-9]{8,})', 1) AS t FROM fin WHERE image_url <> ''),
    images AS (SELECT session_id, kind, pattern, count(*) AS images FROM (SELECT session_id, 'numeric' AS kind, 'numeric-' || substr(n, 1, 4) || '...' AS pattern FROM img WHERE n <> ''
      UNION ALL SELECT session_id, 'mixed', 'mixed-' || substr(t, 1, 6) || '...' FROM img WHERE t <> '' AND NOT regexp_matches(t, '^[A-Z]')) GROUP BY ALL)"""
UNITS = """units AS (SELECT session_id, avg_cart_price, avg_product_price, CASE WHEN avg_cart_price > 1000 THEN 'cents' ELSE 'dollars' END AS cart_unit, CASE WHEN avg_product_price < 1000 THEN 'dollars' ELSE 'cents' END AS product_unit
      FROM (SELECT session_id, coalesce(a, 0) AS avg_cart_price, coalesce(b, 0) AS avg_product_price FROM (SELECT session_id, avg(item_price) AS a FROM fin GROUP BY 1) FULL JOIN (SELECT session_id, avg(price_min) AS b FROM up GROUP BY 1) USING (session_id)))"""
COLORS = """lost AS (SELECT DISTINCT session_id, lower(color) AS color FROM fin WHERE color <> '' EXCEPT SELECT session_id, lower(c) FROM (SELECT session_id, unnest(color_list) AS c FROM v WHERE url IS NOT NULL))"""
RELIABLE = """rel AS (SELECT session_id, count(*) AS attempts, count(*) FILTER (EXISTS (SELECT 1 FROM hits h WHERE h.session_id = fin.session_id AND h.item_pos = fin.item_pos AND h.strategy = 'extracted_id')) AS matches FROM fin WHERE coalesce(url, '') <> '' GROUP BY 1)"""


def _suggest(cte: str, category: str, title: str, priority: str, impact: str, where: str = "true") -> str:
    return f"SELECT session_id, '{category}' AS category, '{title}' AS title, {priority} AS priority, cast({impact} AS bigint) AS impact FROM {cte} WHERE {where}"


_URLS = f"""uq AS (SELECT session_id, q FROM ({parts_sql("SELECT session_id, url FROM v UNION ALL SELECT session_id, url FROM fin")}) WHERE err IS NULL AND q <> ''),
    unused AS (SELECT session_id, count(*) AS impact, bool_or(len(list_filter(string_split(q, '&'), lambda p: lower(split_part(p, '=', 1)) NOT IN ('id', 'productid', 'sku', 'pid', 'product_id'))) > 0) AS any_unused FROM uq GROUP BY 1)"""
SUGGESTIONS = f"""WITH {BASE}, {HITS}, {MINED_TITLES}, {IMAGES}, {UNITS}, {COLORS}, {RELIABLE}, {_URLS}
    {_suggest("unused", "ids", "unused_query_parameters", "'medium'", "impact", "any_unused")}
    UNION ALL {_suggest("(SELECT session_id, coalesce(sum(images) FILTER (kind = 'numeric'), 0) AS n FROM images GROUP BY 1)", "image_skus", "image_sku_patterns", "CASE WHEN n > 0 THEN 'high' ELSE 'low' END", "n")}
    UNION ALL {_suggest("(SELECT session_id, count(prefix) AS n FROM mined GROUP BY 1)", "titles", "brand_prefixes", "CASE WHEN n > 1 THEN 'medium' ELSE 'low' END", "n", "n > 0")}
    UNION ALL {_suggest("(SELECT session_id, count(suffix) AS n FROM mined GROUP BY 1)", "titles", "size_suffixes", "'low'", "n", "n > 0")}
    UNION ALL {_suggest("units", "prices", "price_units", "'medium'", "1", "cart_unit <> product_unit")}
    UNION ALL {_suggest("(SELECT session_id, count(*) AS n FROM lost GROUP BY 1)", "title_colors", "color_synonyms", "CASE WHEN n > 2 THEN 'medium' ELSE 'low' END", "n")}
    UNION ALL {_suggest("rel", "confidence", "trusted_extracted_ids", "'low'", "matches", "matches / attempts > 0.9")}"""

AVAILABLE = f"""WITH {BASE}, {HITS}, {SIMILAR},
    ap AS (SELECT session_id, count(*) AS products, count(*) FILTER (skus > 0) AS with_skus, count(*) FILTER (extracted_ids > 0) AS with_ids, count(*) FILTER (colors > 0) AS with_colors, coalesce(avg(skus) FILTER (skus > 0), 0) AS avg_skus FROM ups GROUP BY 1),
    al AS (SELECT session_id, count(*) AS lines, count(*) FILTER (len(image_skus) > 0) AS with_image_skus, count(*) FILTER (len(url_ids) > 0) AS with_url_ids, count(*) FILTER (coalesce(url, '') <> '') AS with_url, count(*) FILTER (color <> '') AS with_color FROM fin GROUP BY 1),
    ah AS (SELECT session_id, {", ".join(f"count(DISTINCT item_pos) FILTER (strategy = '{n}') AS hit_{n}" for n in ("extracted_id_sku", "url", "extracted_id", "image_sku", "title_color"))} FROM hits GROUP BY 1),
    a AS (SELECT al.*, ap.* EXCLUDE (session_id), ah.* EXCLUDE (session_id), will_match AS hit_title FROM al LEFT JOIN ap USING (session_id) LEFT JOIN ah USING (session_id) LEFT JOIN buckets USING (session_id))
    SELECT session_id, r.strategy AS strategy, coalesce(r.p, 0) AS products_with_field, coalesce(r.l, 0) AS lines_with_field, coalesce(r.h, 0) AS lines_hit, coalesce(products, 0) AS products, lines, round(coalesce(avg_skus, 0), 6) AS avg_skus
    FROM (SELECT *, unnest([{", ".join(f"{{'strategy': '{n}', 'p': {p}, 'l': {l}, 'h': {h}}}" for n, p, l, h in [
        ("sku", "with_skus", "0", "0"), ("variant_sku", "with_skus", "0", "0"), ("image_sku", "with_skus", "with_image_skus", "hit_image_sku"),
        ("extracted_id_sku", "with_skus", "with_url_ids", "hit_extracted_id_sku"), ("url", "products", "with_url", "hit_url"), ("extracted_id", "with_ids", "with_url_ids", "hit_extracted_id"),
        ("title_color", "with_colors", "with_color", "hit_title_color"), ("title", "products", "lines", "hit_title")])}]) AS r FROM a)"""

_RULES = " OR ".join(f"regexp_matches(m_url, {text('(?i)' + r[0])})" for r in NON_PRODUCT_RULES)

ORACLE: dict[str, str] = {
    "session_store_metadata": f"WITH {_STORE} SELECT *, store_id_count <= 1 AND store_name_count <= 1 AND domain_count <= 1 AS is_consistent FROM meta",
    "unique_products": f"WITH {BASE} SELECT * EXCLUDE (first_pos) FROM ups",
    "unique_product_values": f"WITH {BASE} SELECT * FROM vals",
    "cart_evolution": f"WITH {BASE}, {EVOLUTION} SELECT * FROM evo",
    "final_cart": f"""WITH {BASE}, {EVOLUTION} SELECT session_id, arg_max(cart_pos, {{'t': ts, 'p': cart_pos}}) AS latest_cart_pos, arg_max(item_count, {{'t': ts, 'p': cart_pos}}) AS latest_item_count, arg_max(cart_total, {{'t': ts, 'p': cart_pos}}) AS latest_cart_total,
        max(cart_pos) AS arrived_cart_pos, arg_max(item_count, cart_pos) AS arrived_item_count, arg_max(cart_total, cart_pos) AS arrived_cart_total FROM evo GROUP BY 1""",
    "session_data_quality": f"WITH {QUALITY} SELECT * FROM quality",
    "data_quality_issues": f"WITH {QUALITY} SELECT session_id, issue, rows FROM (UNPIVOT quality ON missing_url, no_skus, malformed_url, cart_line_without_url INTO NAME issue VALUE rows) WHERE rows > 0",
    "match_potential": f"""WITH {BASE}, {HITS}, f AS (SELECT session_id, item_pos, EXISTS (SELECT 1 FROM hits h WHERE h.session_id = fin.session_id AND h.item_pos = fin.item_pos AND h.strategy IN ('same_name', 'same_url', 'extracted_id')) AS hit FROM fin)
        SELECT session_id, count(*) FILTER (hit) AS lines_with_views, count(*) FILTER (NOT hit) AS lines_without_views, round(count(*) FILTER (hit) * 100.0 / count(*), 6) AS match_rate FROM f GROUP BY 1""",
    "predict_match_strategy": f"WITH {PREDICT} SELECT * FROM pred",
    "strategy_distribution": f"""WITH {PREDICT} SELECT 'strategy' AS dimension, predicted AS value, count(*) AS items, round(count(*) * 100.0 / (SELECT count(*) FROM pred), 6) AS percent FROM pred WHERE predicted IS NOT NULL GROUP BY predicted
        UNION ALL SELECT 'confidence', confidence, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM pred), 6) FROM pred GROUP BY confidence""",
    "id_extraction_rates": f"WITH {BASE}, {RATES} SELECT * FROM rates",
    "id_overlap": f"WITH {BASE}, {HITS}, {OVERLAP} SELECT * FROM overlap",
    "session_quality_score": f"""WITH {PREDICT}, {RATES}, {OVERLAP}, {QUALITY[len(BASE) + 2:]},
        pts AS (SELECT session_id, sum(CASE confidence WHEN 'high' THEN 100.0 WHEN 'medium' THEN 70.0 ELSE 40.0 END) AS points FROM pred GROUP BY 1),
        s AS (SELECT session_id, CASE WHEN missing_url + no_skus + malformed_url + cart_line_without_url > 0 THEN 70.0 ELSE 100.0 END AS data_quality,
          CASE WHEN product_urls > 0 THEN product_urls_with_ids * 100.0 / product_urls ELSE 0.0 END AS id_extraction, CASE WHEN rates.cart_lines > 0 THEN coalesce(overlap_ids, 0) * 100.0 / rates.cart_lines ELSE 0.0 END AS id_overlap,
          CASE WHEN rates.cart_lines > 0 THEN points / rates.cart_lines ELSE 0.0 END AS match_confidence FROM quality LEFT JOIN rates USING (session_id) LEFT JOIN overlap USING (session_id) LEFT JOIN pts USING (session_id)),
        t AS (SELECT *, cast(floor(round(data_quality * 0.1 + id_extraction * 0.25 + id_overlap * 0.25 + match_confidence * 0.4, 6)) AS bigint) AS score FROM s)
        SELECT session_id, data_quality, round(id_extraction, 6) AS id_extraction, round(id_overlap, 6) AS id_overlap, round(match_confidence, 6) AS match_confidence, score,
          CASE WHEN score >= 80 THEN 'ready' WHEN score >= 60 THEN 'moderate' ELSE 'needs_improvement' END AS band FROM t""",
    "strategy_availability": AVAILABLE,
    "title_similarity_buckets": f"WITH {BASE}, {SIMILAR} SELECT * FROM buckets",
    "query_param_frequency": f"""WITH u AS (SELECT unnest(string_split(q, '&')) AS part FROM ({parts_sql("SELECT url FROM (" + ALL_URLS + ") UNION ALL SELECT url FROM (" + view_sql("url_log") + ")")}) WHERE err IS NULL AND q <> '')
        SELECT split_part(part, '=', 1) AS param, count(*) AS urls, lower(split_part(part, '=', 1)) NOT IN ('id', 'productid', 'sku', 'pid', 'product_id') AS unused FROM u WHERE part <> '' GROUP BY 1""",
    "image_id_patterns": f"WITH {BASE}, {IMAGES} SELECT * FROM images",
    "title_prefix_suffix_mining": f"WITH {BASE}, {MINED_TITLES} SELECT * FROM mined",
    "price_unit_check": f"WITH {BASE}, {UNITS} SELECT session_id, round(avg_cart_price, 4) AS avg_cart_price, round(avg_product_price, 4) AS avg_product_price, cart_unit, product_unit, cart_unit <> product_unit AS mismatch FROM units",
    "unmatched_colors": f"WITH {BASE}, {COLORS} SELECT * FROM lost",
    "extracted_id_reliability": f"WITH {BASE}, {HITS}, {RELIABLE} SELECT session_id, attempts, matches, round(matches / attempts, 6) AS reliability, matches / attempts > 0.9 AS upgrade FROM rel",
    "improvement_suggestions": SUGGESTIONS,
    "session_registry_status": f"""WITH {_STORE}, reg AS ({view_sql("store_registry")}), al AS (SELECT unnest(aliases) AS a FROM reg),
        ids AS (SELECT id FROM reg WHERE id IS NOT NULL UNION SELECT a.id FROM al), doms AS (SELECT domain FROM reg UNION SELECT a.domain FROM al),
        first AS (SELECT session_id, count(*) AS sampled, count(*) FILTER (len(url_ids) > 0) AS sampled_with_ids FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY view_pos) AS rn FROM v) WHERE rn <= 5 GROUP BY 1)
        SELECT session_id, store_id, domain, store_id IN (SELECT id FROM ids) AS known_by_id, domain IN (SELECT domain FROM doms) AS known_by_domain, coalesce(sampled, 0) AS sampled, coalesce(sampled_with_ids, 0) AS sampled_with_ids FROM meta LEFT JOIN first USING (session_id)""",
    "new_golden_candidates": f"""WITH {_STORE}, urls AS (SELECT session_id, url FROM v WHERE url <> '' UNION SELECT session_id, url FROM fin WHERE url <> ''),
        checked AS (SELECT session_id, m_url, m_err, regexp_replace(host, '^www\\.', '') AS got, regexp_replace(domain, '^www\\.', '') AS want FROM ({mined_sql("SELECT urls.session_id, urls.url, meta.domain FROM urls JOIN meta USING (session_id)")})),
        kept AS (SELECT DISTINCT session_id, m_url AS product_url FROM checked WHERE (want = '' OR (m_err IS NULL AND (contains(got, want) OR contains(want, got)))) AND NOT ({_RULES})),
        shaped AS (SELECT session_id, product_url, shape_ids FROM ({shape_sql(mined_sql("SELECT * FROM kept", "product_url"))}) WHERE len(shape_ids) > 0)
        SELECT session_id, product_url, array_to_string(shape_ids, '|') AS shape_ids FROM shaped WHERE product_url NOT IN (SELECT m_url FROM ({mined_sql(view_sql("known_golden"))}))""",
}
