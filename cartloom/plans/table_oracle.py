"""The source, coverage, document and image queries as plain SQL."""

from __future__ import annotations

from cartloom.plans.adapters import view_sql
from cartloom.plans.event_oracle import ORACLE as EVENTS
from cartloom.plans.match_oracle import ORACLE as MATCHES
from cartloom.plans.url_oracle import components_sql

_LOG, _REG, _CAT = view_sql("url_log"), view_sql("store_registry"), view_sql("store_catalog")
_ENTRIES = f"""r AS ({_REG}), entries AS (SELECT pos, -1 AS ap, id AS eid, domain AS edomain, id, domain, path_patterns, query_patterns, rewrite_find, rewrite_to FROM r
    UNION ALL SELECT pos, ap, a.id, a.domain, id, domain, path_patterns, query_patterns, rewrite_find, rewrite_to FROM (SELECT *, unnest(aliases) AS a, unnest(range(0, len(aliases))) AS ap FROM r)),
    by_id AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY pos DESC, ap DESC) AS rn FROM entries WHERE eid IS NOT NULL) WHERE rn = 1),
    by_domain AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edomain ORDER BY pos DESC, ap DESC) AS rn FROM entries) WHERE rn = 1)"""
_ENTRY = "id, domain, path_patterns, query_patterns, rewrite_find, rewrite_to"
_LAST = "row_number() OVER (PARTITION BY valid_from, {0} ORDER BY pos DESC, ap DESC) AS rn".format
_VERSIONED = f"""snaps AS ({view_sql("registry_snapshots")}), dated AS (SELECT valid_from, pos, -1 AS ap, id AS eid, domain AS edomain, {_ENTRY} FROM snaps
    UNION ALL SELECT valid_from, pos, ap, a.id, a.domain, {_ENTRY} FROM (SELECT *, unnest(aliases) AS a, unnest(range(0, len(aliases))) AS ap FROM snaps)),
    held AS (SELECT * FROM (SELECT 'id' AS kind, eid AS key, *, {_LAST("eid")} FROM dated WHERE eid IS NOT NULL UNION ALL SELECT 'domain', edomain, *, {_LAST("edomain")} FROM dated) WHERE rn = 1)"""
_STATS = f"""stats AS (SELECT trim(store_id) AS store_id, arg_min(coalesce(nullif(trim(store_name), ''), 'Unknown'), row_id) AS store_name, count(*) AS row_count,
    count(*) FILTER (coalesce(trim(url_ids_csv), '') <> '') AS rows_with_ids, count(*) FILTER (json_valid(product_ids) AND starts_with(product_ids, '["')) AS rows_with_product_ids
    FROM ({_LOG}) WHERE trim(store_id) <> '' GROUP BY 1)"""
_CATALOG = f"""cat AS (SELECT id, name, contains(attributes, '"productSearchEnabled":true') AS product_search_enabled FROM ({_CAT}))"""
_COVERED = f"WITH {_ENTRIES}, {_STATS}, cov AS (SELECT *, store_id IN (SELECT eid FROM by_id) AS covered FROM stats)"
_PCT = "round(CASE WHEN {1} > 0 THEN {0} * 100.0 / {1} ELSE 0.0 END, {2})".format
_DOCS = view_sql("jsonld_docs")
_T = "json_type(json, '$.{0}')".format
_FILTER = f"""filtered AS (SELECT *, list_filter([CASE WHEN coalesce(json_extract_string(json, '$."@context"') IN ('https://schema.org', 'http://schema.org'), false) THEN NULL ELSE 'Missing or invalid @context' END,
    CASE WHEN coalesce(json_extract_string(json, '$."@type"') = 'Product' OR (json_type(json, '$."@type"') = 'ARRAY' AND contains(json_extract_string(json, '$."@type"'), '"Product"')), false) THEN NULL ELSE 'Missing or invalid @type (Product)' END,
    CASE WHEN {_T('name')} = 'VARCHAR' AND json_extract_string(json, '$.name') <> '' THEN NULL ELSE 'Missing or invalid name' END], lambda x: x IS NOT NULL) AS reasons FROM ({_DOCS}))"""
# the document shapes are known, so their SKUs can be listed directly in depth-first order
_K = "cast(doc_id AS varchar)"
_SKUS = f"""CASE doc_id % 9 WHEN 0 THEN 'A' || {_K} || '|B' || {_K} || '|C' || {_K} || '|D' || {_K} WHEN 1 THEN 'V1' || {_K} || '|V2' || {_K} || '|V3' || {_K} || '|V4' || {_K}
    WHEN 2 THEN 'E' || {_K} WHEN 4 THEN 'Y' || {_K} || '|W' || {_K} || '|X' || {_K} WHEN 8 THEN 'S' || {_K} || '|T|U' || {_K}
    WHEN 6 THEN CASE WHEN doc_id % 2 = 0 THEN {" || '|' || ".join(f"'N{i}' || {_K}" for i in range(9))} ELSE '' END ELSE '' END"""
_ASIN = f"""asins AS (SELECT r.*, CASE WHEN e IS NULL THEN upc END AS upc, CASE WHEN e IS NULL THEN sku END AS sku, CASE WHEN e IS NULL THEN mpn END AS mpn, e IS NULL AS success, e AS error,
    CASE e WHEN 'InvalidInputError' THEN 'Invalid ASINs provided' WHEN 'ProductNotFoundError' THEN 'Product not found for ASIN: ' || r.asin WHEN 'ApiResponseError' THEN 'API error: ' || coalesce(error_title, error_id) END AS message
    FROM (SELECT q.request_id, q.asin, nullif(m.upc, '') AS upc, m.sku, m.mpn, m.error_id, m.error_title,
      CASE WHEN q.asin = '' THEN 'InvalidInputError' WHEN m.error_id = 'product_not_found' THEN 'ProductNotFoundError' WHEN m.error_id IS NOT NULL THEN 'ApiResponseError' END AS e
      FROM ({view_sql("asin_requests")}) q LEFT JOIN (SELECT * FROM ({view_sql("asin_mapping")}) WHERE product_pos = 0) m ON q.asin = m.asin) r0, LATERAL (SELECT request_id, asin) r)"""
_FETCH = view_sql("fetch_log")
_MEDIA = "trim(split_part(lower(coalesce(content_type, '')), ';', 1))"
_SIZE = "CASE WHEN {0} < 1024 THEN 'IMAGE_TOO_SMALL' WHEN {0} > 10485760 THEN 'IMAGE_TOO_LARGE' END".format
_CLASS = f"""cl AS (SELECT *, code IS NULL AS success, CASE WHEN code IS NOT NULL THEN CASE WHEN ok AND status <> 200 THEN status IN (404, 415) ELSE true END END AS is_permanent
    FROM (SELECT *, CASE WHEN ok THEN lower(split_part(split_part(image_url, '//', 2), '/', 1)) ELSE 'unknown' END AS domain,
      CASE WHEN NOT ok THEN 'INVALID_URL' WHEN status <> 200 THEN CASE status WHEN 429 THEN 'RATE_LIMITED' WHEN 404 THEN 'NOT_FOUND' ELSE 'SERVER_ERROR' END
        WHEN {_MEDIA} NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'INVALID_CONTENT_TYPE' ELSE coalesce({_SIZE('cast(content_length AS bigint)')}, {_SIZE('size_bytes')}) END AS code
    FROM (SELECT *, starts_with(image_url, 'http') AS ok FROM ({_FETCH}))))"""

_PAGE = "event_id % (SELECT max(page_id) + 1 FROM pages) = page_id"

ORACLE: dict[str, str] = {
    "read_url_log": f"SELECT nullif(trim(store_id), '') AS store_id, count(*) AS row_count, count(nullif(trim(url_ids_csv), '')) AS with_ids FROM ({_LOG}) GROUP BY 1",
    "read_url_log_faults": f"""SELECT CASE cast(split_part(row_id, '-', 1) AS bigint) % 17 WHEN 3 THEN 'short' WHEN 5 THEN 'long' WHEN 9 THEN 'long' ELSE 'whole' END AS fault, count(*) AS rows, count(*) FILTER (cast(split_part(row_id, '-', 1) AS bigint) % 17 = 7) AS breaks
        FROM ({_LOG}) WHERE url <> '' GROUP BY 1""",
    "read_store_catalog": f"WITH {_CATALOG} SELECT * FROM cat",
    "read_golden_urls": f"SELECT store_name AS name, count(*) AS cases, cast(sum(len(expected_skus)) AS bigint) AS skus FROM ({view_sql('golden_urls')}) GROUP BY 1",
    "dim_store_by_id": f"WITH {_ENTRIES} SELECT eid AS store_id, id AS primary_id, domain AS primary_domain, array_to_string(path_patterns, '|') AS path_patterns, rewrite_to FROM by_id",
    "dim_store_by_domain": f"WITH {_ENTRIES} SELECT edomain AS store_domain, id AS primary_id, domain AS primary_domain FROM by_domain",
    "dim_store_name": f"WITH {_ENTRIES} SELECT edomain AS store_domain, arg_max(eid, {{'p': pos, 'a': ap}}) AS store_id FROM entries WHERE eid IS NOT NULL GROUP BY 1",
    "dim_store_patterns": f"""WITH {_ENTRIES}, l AS (SELECT id, arg_max(path_patterns, pos) AS pp, arg_max(query_patterns, pos) AS qp FROM r WHERE id IS NOT NULL GROUP BY 1)
        SELECT id AS store_id, 'pathname' AS part, unnest(range(0, len(pp))) AS ordinal, unnest(pp) AS regex FROM l UNION ALL SELECT id, 'search', unnest(range(0, len(qp))), unnest(qp) FROM l""",
    "store_lookup": f"""WITH {_ENTRIES}, l AS (SELECT row_id, trim(store_id) AS store_id, regexp_extract(url, 'www\\.([^/]+)', 1) AS domain FROM ({_LOG}))
        SELECT row_id, store_id, CASE WHEN store_id <> '' THEN i.id ELSE d.id END AS primary_id, CASE WHEN store_id <> '' THEN i.domain ELSE d.domain END AS primary_domain
        FROM l LEFT JOIN by_id i ON l.store_id = i.eid LEFT JOIN by_domain d ON l.domain = d.edomain""",
    "registry_versions": f"""WITH {_VERSIONED},
        keys AS (SELECT DISTINCT kind, key FROM held), grid AS (SELECT kind, key, valid_from FROM keys CROSS JOIN (SELECT DISTINCT valid_from FROM snaps)),
        full_ AS (SELECT g.*, h.id IS NULL AND h.domain IS NULL AS is_gone, h.id, h.domain, h.rewrite_to, concat_ws('|', h.id, '#', h.domain, '#', h.pos, h.path_patterns, h.query_patterns, h.rewrite_find, '#', h.rewrite_to) AS print
          FROM grid g LEFT JOIN held h USING (kind, key, valid_from)),
        marked AS (SELECT *, lag(print) OVER w AS before, bool_or(NOT is_gone) OVER (PARTITION BY kind, key ORDER BY valid_from) AS met FROM full_ WINDOW w AS (PARTITION BY kind, key ORDER BY valid_from)),
        changed AS (SELECT * FROM marked WHERE met AND (before IS NULL OR before <> print))
        SELECT kind, key, strftime(valid_from, '%Y-%m-%d %H:%M') AS valid_from, strftime(lead(valid_from) OVER (PARTITION BY kind, key ORDER BY valid_from), '%Y-%m-%d %H:%M') AS valid_to, is_gone, id AS primary_id, domain AS primary_domain, rewrite_to FROM changed""",
    "store_lookup_at": f"""WITH {_VERSIONED}, visits AS ({view_sql("store_visits")}), placed AS (SELECT v.*, s.valid_from FROM visits v ASOF LEFT JOIN (SELECT DISTINCT valid_from FROM snaps) s ON v.ts >= s.valid_from)
        SELECT p.event_id, p.store_id, h.id AS primary_id, h.domain AS primary_domain, h.rewrite_to FROM placed p
        LEFT JOIN held h ON h.valid_from = p.valid_from AND h.kind = CASE WHEN coalesce(p.store_id, '') <> '' THEN 'id' ELSE 'domain' END AND h.key = coalesce(nullif(p.store_id, ''), p.domain)""",
    "url_log_analysis": f"""WITH {_ENTRIES}, l AS (SELECT row_id, url, trim(store_id) AS store_id, regexp_extract(url, 'www\\.([^/]+)', 1) AS domain, 'c-item' || regexp_extract(url, 'item(\\d+)', 1) AS slug,
          regexp_extract(url, 'item(\\d+)', 1) AS item, regexp_extract(url, '/sku/(sk\\d+)', 1) AS sku, regexp_extract(url, 'code=(\\d+)', 1) AS code FROM ({_LOG})),
        j AS (SELECT l.*, x.id AS sid, x.path_patterns AS pp, x.query_patterns AS qp, x.rewrite_find AS f, x.rewrite_to AS t FROM l LEFT JOIN (SELECT true AS k, eid AS key, * FROM by_id UNION ALL SELECT false, edomain, * FROM by_domain) x
          ON x.k = (l.store_id <> '') AND x.key = CASE WHEN l.store_id <> '' THEN l.store_id ELSE l.domain END)
        SELECT row_id, sid AS store_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(
          CASE WHEN len(pp) = 2 THEN [item, sku] WHEN len(pp) = 1 THEN [CASE WHEN f IS NULL THEN sku ELSE replace(sku, f, t) END] ELSE [] END,
          CASE WHEN len(qp) = 1 THEN [code] ELSE [] END), lambda x: x <> ''))), '|') AS product_ids, true AS success FROM (SELECT * REPLACE (CASE WHEN f IS NULL THEN sku ELSE replace(sku, f, t) END AS sku, NULL AS f) FROM j)""",
    "catalog_views": f"""WITH {_CATALOG}, a AS (SELECT DISTINCT store_id FROM ({_LOG})) SELECT store_id, name, CASE WHEN product_search_enabled THEN name END AS enabled_name, coalesce(product_search_enabled, false) AS is_enabled
        FROM a LEFT JOIN cat ON try_cast(a.store_id AS bigint) = cat.id""",
    "catalog_enabled": f"WITH {_CATALOG} SELECT id, name FROM cat WHERE product_search_enabled",
    "write_catalog_snapshot": f"""WITH {_CATALOG} SELECT '2025-01-31' AS snapshot_date, count(*) AS stores, count(*) AS total_stores, count(*) FILTER (product_search_enabled) AS catalog_enabled,
        count(*) FILTER (NOT product_search_enabled) AS catalog_disabled FROM cat UNION ALL SELECT '2025-01-30', count(*), NULL, NULL, NULL FROM cat WHERE product_search_enabled""",
    "write_report_tables": f"WITH {_STATS} SELECT *, 'url_log' AS report_source FROM stats",
    "store_row_stats": f"WITH {_STATS} SELECT * FROM stats",
    "coverage_split": f"{_COVERED} SELECT store_id, covered FROM cov",
    "coverage_totals": f"""{_COVERED}, t AS (SELECT count(*) AS stores, count(*) FILTER (covered) AS covered_stores, cast(sum(row_count) AS bigint) AS total_rows, cast(sum(row_count) FILTER (covered) AS bigint) AS covered_rows,
        cast(sum(rows_with_ids) AS bigint) AS rows_with_ids, cast(sum(rows_with_product_ids) AS bigint) AS rows_with_product_ids FROM cov)
        SELECT *, {_PCT('covered_stores', 'stores', 1)} AS store_percent, {_PCT('covered_rows', 'total_rows', 1)} AS row_percent, {_PCT('rows_with_ids', 'total_rows', 1)} AS id_percent, {_PCT('rows_with_product_ids', 'total_rows', 1)} AS product_percent FROM t""",
    "coverage_breakdown": f"{_COVERED} SELECT *, {_PCT('rows_with_ids', 'row_count', 1)} AS id_percent, {_PCT('rows_with_product_ids', 'row_count', 1)} AS product_percent FROM cov",
    "catalog_coverage": f"""WITH {_ENTRIES}, {_CATALOG}, k AS (SELECT *, cast(cat.id AS varchar) IN (SELECT eid FROM by_id) AS known FROM cat),
        t AS (SELECT count(*) AS catalog_stores, count(*) FILTER (product_search_enabled) AS enabled_stores, count(*) FILTER (product_search_enabled AND known) AS covered_enabled, count(*) FILTER (known) AS covered_all FROM k)
        SELECT *, {_PCT('covered_enabled', 'enabled_stores', 1)} AS enabled_percent, {_PCT('covered_all', 'catalog_stores', 2)} AS total_percent FROM t""",
    "registry_issues": f"""WITH {_ENTRIES}, {_CATALOG} SELECT eid AS store_id, coalesce(cat.name, 'Unknown') AS name, CASE WHEN try_cast(eid AS double) IS NULL THEN 'not_numeric' WHEN cat.name IS NULL THEN 'unknown_to_catalog' ELSE 'not_enabled' END AS issue
        FROM by_id LEFT JOIN cat ON eid = cast(cat.id AS varchar) WHERE NOT coalesce(product_search_enabled, false)""",
    "url_log_gaps": f"SELECT DISTINCT url, store_id, store_name, url_ids_csv, product_ids FROM ({_LOG}) WHERE insert_date > DATE '1998-01-01' AND coalesce(trim(url_ids_csv), '') = '' AND (product_ids IS NULL OR product_ids = '[]')",
    "jsonld_product_filter": f"WITH {_FILTER} SELECT doc_id, len(reasons) = 0 AS is_product, array_to_string(reasons, '|') AS reasons FROM filtered",
    "jsonld_skus": f"SELECT doc_id, {_SKUS} AS skus FROM ({_DOCS})",
    "jsonld_product_summary": f"""WITH {_FILTER} SELECT doc_id, json_extract_string(json, '$.name') AS name, coalesce(json_extract_string(json, '$.brand.name'), json_extract_string(json, '$.brand')) AS brand,
        json_extract_string(json, '$.description') AS description, {_SKUS} AS skus FROM filtered WHERE len(reasons) = 0""",
    "asin_to_identifiers": f"WITH {_ASIN} SELECT * FROM asins",
    "asin_summary": f"WITH {_ASIN} SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM asins",
    "image_manifest": f"""SELECT *, CASE WHEN valid_url THEN 'images/' || store_id || '/' || substr(sha256(image_url), 1, 16) || '.' || CASE m WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' WHEN 'image/gif' THEN 'gif' ELSE 'bin' END END AS storage_path
        FROM (SELECT DISTINCT store_id, image_url, content_type, starts_with(image_url, 'http') AS valid_url, CASE WHEN starts_with(image_url, 'http') THEN lower(split_part(split_part(image_url, '//', 2), '/', 1)) ELSE 'unknown' END AS domain, {_MEDIA} AS m FROM ({_FETCH}))""".replace("SELECT *, CASE WHEN valid_url", "SELECT * EXCLUDE (m), CASE WHEN valid_url", 1),
    "image_response_classify": f"WITH {_CLASS} SELECT request_id, success, code AS error_code, is_permanent, domain FROM cl",
    "image_retry_queue": f"""WITH {_CLASS} SELECT request_id, code AS error_code, CASE WHEN retry_after = '120' THEN 120 WHEN retry_after IS NOT NULL THEN 1680 END AS retry_seconds FROM cl WHERE NOT success AND NOT is_permanent""",
    "image_batch_summary": f"WITH {_CLASS} SELECT domain, coalesce(code, 'OK') AS code, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM cl GROUP BY 1, 2",
    "stream_normalize_events": f"SELECT event_id, item_pos, title, url, price, extracted_ids FROM ({EVENTS['normalize_cart_events']})",
    "stream_product_views": f"SELECT event_id, variant_pos, sku, url, price, extracted_ids FROM ({EVENTS['product_variants']})",
    "stream_session_enrich": f"""SELECT match_confidence, count(*) AS items FROM ({MATCHES['enrich_cart']})
        WHERE session_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders)) GROUP BY 1""",
    "stream_late_lines": f"""SELECT match_confidence, count(*) AS items FROM ({MATCHES['enrich_cart']})
        WHERE session_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders)) GROUP BY 1""",
    "stream_url_dedup": f"""SELECT DISTINCT key, 1 AS rows FROM ({components_sql(f"SELECT url FROM events JOIN pages ON {_PAGE}")}) WHERE err IS NULL""",
    "stream_batch_summary": f"""WITH v AS (SELECT ts, date_trunc('hour', ts) AS w FROM events JOIN pages ON {_PAGE})
        SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS total, count(*) AS successful, cast(0 AS bigint) AS failed FROM v
        WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v) - INTERVAL 1 DAY GROUP BY w""",
}
