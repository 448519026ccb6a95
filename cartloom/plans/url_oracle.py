"""The URL queries as plain SQL for the checking engine, written independently of the Spark column code."""

from __future__ import annotations

from cartloom.functions.urls import BRAND_SUBDOMAINS, COUNTRY_LEVELS, PUBLIC_SUFFIXES, TRACKING_PARAMS
from cartloom.operators.url_mining import GENERIC_PARAMS, ID_PARAMS, NON_PRODUCT_RULES, SECONDARY_PARAMS
from cartloom.plans.adapters import view_sql
from cartloom.sources.store_rules import STORES


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


ALL_URLS = f"""
SELECT 'page-' || cast(page_id AS varchar) AS url_id, url, cast(NULL AS varchar) AS store_id FROM pages
UNION ALL SELECT 'part-' || cast(page_id AS varchar), url, store_id FROM ({view_sql("product_urls")})"""

SUFFIX2 = text_list(s for s in PUBLIC_SUFFIXES if s.count(".") == 1)
SUFFIX3 = text_list(s for s in PUBLIC_SUFFIXES if s.count(".") == 2)


def parts_sql(src: str, url: str = "url") -> str:
    """Split of a URL: ``u, sch, host, port, path, q, tail, err``."""
    return f"""
    SELECT *, CASE WHEN coalesce({url}, '') = '' OR sch NOT IN ('http', 'https') OR host = '' OR regexp_matches(host, '[ <>|^%]') THEN 'InvalidUrlError' END AS err
    FROM (SELECT *, lower(regexp_replace(authority, ':[0-9]*$', '')) AS host, regexp_extract(authority, ':([0-9]+)$', 1) AS port
    FROM (SELECT *, split_part(rest, '/', 1) AS authority, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
    FROM (SELECT *, regexp_replace(split_part(main, '?', 1), '^[A-Za-z]+:/*', '') AS rest,
        CASE WHEN strpos(main, '?') > 0 THEN substr(main, strpos(main, '?') + 1) ELSE '' END AS q
    FROM (SELECT *, split_part(u, '#', 1) AS main, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch
    FROM (SELECT *, CASE WHEN starts_with({url}, 'www.') THEN 'https://' || {url} ELSE {url} END AS u FROM ({src}) s0) s1) s2) s3) s4) s5"""


def components_sql(src: str, url: str = "url") -> str:
    """Normalised components of the valid and invalid URLs of a source."""
    tail = "array_to_string(list_slice(labels, greatest(len(labels) - {} + 1, 1), len(labels)), '.')".format
    return f"""
    SELECT *, 'https://' || hostname || pathname || search AS href,
      regexp_replace(substr(base64(unhex(sha1(domain || lower(pathname) || lower(search)))), 1, 16), '[+/=]', '_', 'g') AS key
    FROM (SELECT *, CASE WHEN brand IS NOT NULL AND NOT starts_with(base, brand || '.') THEN brand || '.' || base ELSE base END AS domain
    FROM (SELECT *, list_filter(string_split(substr(hostname, 1, greatest(length(hostname) - length(base) - 1, 0)), '.'),
        lambda b: b IN {text_list(BRAND_SUBDOMAINS)})[1] AS brand
    FROM (SELECT *, CASE WHEN regexp_matches(hostname, '^[0-9.]+$') THEN hostname WHEN {tail(3)} IN {SUFFIX3} THEN {tail(4)}
        WHEN {tail(2)} IN {SUFFIX2} OR regexp_matches({tail(2)}, '^({"|".join(COUNTRY_LEVELS)})[.][a-z][a-z]$') THEN {tail(3)} ELSE {tail(2)} END AS base
    FROM (SELECT *, string_split(hostname, '.') AS labels
    FROM (SELECT *,
      CASE WHEN starts_with(host, 'www.') AND NOT starts_with(host, 'www.www.') THEN substr(host, 5) ELSE host END AS hostname,
      CASE WHEN regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') = '' THEN '/'
        ELSE regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') END AS pathname,
      CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(kept), lambda x: x.p), '&') END AS search
    FROM (SELECT *, list_filter(
        list_transform(string_split(q, '&'), lambda p, i: {{'n': split_part(p, '=', 1), 'i': i, 'p': p}}),
        lambda x: x.p <> '' AND x.n NOT IN {text_list(TRACKING_PARAMS)} AND NOT regexp_matches(x.n, '^(utm|fb|hsa)_[0-9A-Za-z_]+')) AS kept
    FROM ({parts_sql(src, url)}) c1) c2) c3) c4) c5) c6) c7"""


def registry_sql() -> str:
    """The built-in rules by lookup key: ``by_id, key, primary_id, find, to_text, paths, queries``."""
    by_id, by_domain = {}, {}
    for store_id, domain, paths, queries, options in STORES:
        find, to = options.get("rewrite", (None, None))
        row = f"{text(store_id)}, {text(find)}, {text(to)}, [{', '.join(map(text, paths))}]::varchar[], [{', '.join(map(text, queries))}]::varchar[]"
        if store_id:
            by_id[store_id] = row
        by_domain[domain] = row
        for alias_id, alias_domain in options.get("aliases", []):
            by_id[alias_id] = row
            by_domain[alias_domain] = row
    rows = [f"(true, {text(k)}, {r})" for k, r in by_id.items()] + [f"(false, {text(k)}, {r})" for k, r in by_domain.items()]
    return "(VALUES " + ", ".join(rows) + ") AS reg(by_id, lookup_key, primary_id, find, to_text, paths, queries)"


_GEN_PATH = [r"\b((?:prod|prd|p)-?([0-9]{6,24}))\b", r"\b(?:/|-)([0-9]{6,24})(?:\.html)?$"]
_GEN_QUERY = r"[?&](?:sku|pid|id|productid|skuid|athcpid|upc_id|variant|prdtno)=([0-9A-Za-z_-]{4,24})"


def ids_sql(src: str, url: str = "url", key: str = "url_id") -> str:
    """CTE body: components plus ``raw_store, store_ids, gen_path, store_query, gen_query, ids`` as sorted lists."""
    e, p = "lower(pathname)", text
    return f"""
    comp AS (SELECT * FROM ({components_sql(src, url)}) WHERE err IS NULL),
    looked AS (SELECT comp.*, reg.primary_id, reg.find, reg.to_text, reg.paths, reg.queries FROM comp LEFT JOIN {registry_sql()}
      ON CASE WHEN coalesce(comp.store_id, '') <> '' THEN reg.by_id AND reg.lookup_key = comp.store_id
         ELSE NOT reg.by_id AND reg.lookup_key = comp.domain END),
    path_hits AS (SELECT {key}, find, to_text, unnest(regexp_extract_all({e}, re, 1)) AS id
      FROM (SELECT {key}, pathname, find, to_text, unnest(paths) AS re FROM looked)),
    path_ids AS (SELECT {key}, list_sort(list_distinct(list(id))) AS raw_store,
        list_sort(list_distinct(list(CASE WHEN find IS NULL THEN id ELSE regexp_replace(id, find, to_text) END))) AS store_ids
      FROM path_hits WHERE id <> '' GROUP BY {key}),
    query_ids AS (SELECT {key}, list_sort(list_distinct(list(id))) AS store_query FROM (
        SELECT {key}, unnest(regexp_extract_all(lower(search), re, 1)) AS id FROM (SELECT {key}, search, unnest(queries) AS re FROM looked))
      WHERE id <> '' GROUP BY {key}),
    found AS (SELECT looked.*, coalesce(raw_store, []) AS raw_store, coalesce(store_ids, []) AS store_ids, coalesce(store_query, []) AS store_query,
        list_sort(list_distinct(list_concat(regexp_extract_all({e}, {p(_GEN_PATH[0])}, 1), regexp_extract_all({e}, {p(_GEN_PATH[0])}, 2),
          regexp_extract_all({e}, {p(_GEN_PATH[1])}, 1)))) AS gen_path,
        list_sort(list_distinct(regexp_extract_all(lower(search), {p(_GEN_QUERY)}, 1))) AS gen_query
      FROM looked LEFT JOIN path_ids USING ({key}) LEFT JOIN query_ids USING ({key})),
    ided AS (SELECT *, list_sort(list_distinct(list_concat(CASE WHEN len(store_ids) > 0 THEN store_ids ELSE gen_path END, store_query, gen_query))) AS ids FROM found),
    final AS (SELECT *, len(list_filter(ids, lambda x: NOT regexp_full_match(x, '[0-9A-Za-z_-]{{1,24}}'))) = 0 AS ids_ok FROM ided)"""


def _j(c: str) -> str:
    return f"array_to_string({c}, '|')"


def _with(body: str, select: str) -> str:
    return f"WITH {body} {select}"


IDS = ids_sql(ALL_URLS)
COMP = components_sql(ALL_URLS)
PARTS = parts_sql(ALL_URLS)

_ANALYSIS = f"""analysis AS (
    SELECT a.url_id, a.url, CASE WHEN f.ids_ok THEN f.primary_id END AS store_id, CASE WHEN f.ids_ok THEN {_j('f.ids')} END AS product_ids,
      CASE WHEN f.ids_ok THEN cast(len(f.ids) AS bigint) END AS id_count, coalesce(f.ids_ok, false) AS success,
      CASE WHEN f.url_id IS NULL THEN 'InvalidUrlError' WHEN NOT f.ids_ok THEN 'ZodError' END AS error,
      CASE WHEN f.url_id IS NOT NULL THEN CASE WHEN NOT f.ids_ok THEN 'Invalid product id' END
        WHEN coalesce(a.url, '') = '' THEN 'URL must be a non-empty string'
        WHEN a.sch = '' OR a.sch IN ('http', 'https') THEN 'Invalid URL format: ' || a.u
        ELSE 'Invalid protocol: ' || a.sch || ':. Only HTTP(S) protocols are allowed' END AS message
    FROM ({PARTS}) a LEFT JOIN final f USING (url_id))"""

MINED = f"""
    SELECT *, CASE WHEN m_err IS NULL THEN sch || '://' || host || CASE WHEN port = '' OR (sch = 'http' AND port = '80') OR (sch = 'https' AND port = '443') THEN '' ELSE ':' || port END
        || m_path || substr(u, length(split_part(split_part(u, '#', 1), '?', 1)) + 1) ELSE lower(trim(url)) END AS m_url
    FROM (SELECT * EXCLUDE (err), err AS m_err, CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(lower(path), '/$', '') ELSE path END AS m_path
    FROM ({parts_sql("SELECT *, CASE WHEN regexp_matches(trim(url), '^(?i)https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS full_url FROM (" + ALL_URLS + ")", "full_url")}) m1) m2"""


def _rule_chain(column: int) -> str:
    rows = "".join(f" WHEN regexp_matches(m_url, {text('(?i)' + r[0])}) THEN {text(r[column])}" for r in NON_PRODUCT_RULES)
    return f"CASE WHEN m_err IS NOT NULL THEN {text(('x', 'other', 'Invalid URL format')[column])} WHEN strpos(bare, 'example.com') = 0 AND strpos('example.com', bare) = 0 THEN " + (
        "'other'" if column == 1 else "'Domain mismatch: expected example.com, got ' || bare"
    ) + rows + " END"


def shape_sql(mined: str) -> str:
    """Id shapes of a source that went through the mining normalisation."""
    value = lambda p: f"regexp_extract(q, '(?:^|&){p}=([^&]*)', 1)"
    last = lambda p: f"regexp_extract(q, '(?i)^.*(?:^|&){p}=([^&]*)', 1)"
    num, alnum = "'^[0-9]{4,}$'", "'^(?i)[a-z0-9]{6,}$'"
    marker = "'^(?i)(p|product|item|dp|pd|sku|prod|products?|items?)$'"
    pre = "'^(?i)([a-z]{1,4}[-_])([0-9]{4,}|[a-z0-9]{6,})$'"
    uuid = "'^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'"
    cand = []
    for back in range(3):
        s = f"segs[len(segs) - {back}]" if back else "segs[len(segs)]"
        ok = f"len(segs) > {back}"
        after = f"(len(segs) > {back + 1} AND regexp_matches(segs[len(segs) - {back + 1}], {marker}))"
        place = f"cast(len(segs) - {back} AS varchar)"
        cand.append(
            f"CASE WHEN NOT ({ok}) THEN NULL"
            f" WHEN regexp_matches({s}, {num}) THEN {{'id': {s}, 'f': 'numeric', 'e': {back}, 'c': CASE WHEN {after} THEN 'high' ELSE 'medium' END, 'd': 'number in path segment ' || {place} || ' (' || {s} || ')', 'x': cast(NULL AS varchar)}}"
            f" WHEN regexp_matches({s}, {pre}) THEN {{'id': lower(regexp_extract({s}, {pre}, 2)), 'f': 'prefixed', 'e': {back}, 'c': 'high', 'd': 'prefix \"' || regexp_replace(regexp_extract({s}, {pre}, 1), '[-_]$', '') || '\" before a number in the path (' || {s} || ')', 'x': regexp_extract({s}, {pre}, 1)}}"
            f" WHEN regexp_matches({s}, {uuid}) THEN {{'id': lower({s}), 'f': 'uuid', 'e': {back}, 'c': 'medium', 'd': 'uuid in path segment ' || {place}, 'x': cast(NULL AS varchar)}}"
            f" WHEN {after} AND regexp_matches({s}, {alnum}) THEN {{'id': lower({s}), 'f': 'alphanumeric', 'e': {back}, 'c': 'high', 'd': 'code after a product word in the path (' || {s} || ')', 'x': cast(NULL AS varchar)}} END"
        )
    by_param = ", ".join(
        f"CASE WHEN regexp_matches({value(p)}, {num}) OR regexp_matches({value(p)}, {alnum}) THEN {{'id': lower({value(p)}), 'p': '{p}', 'v': {value(p)}}} END"
        for p in ID_PARAMS
    )
    extra = ", ".join(f"{{'p': '{p}', 'v': {last(p)}}}" for p in SECONDARY_PARAMS)
    return f"""
    SELECT *, list_concat(CASE WHEN pid IS NULL THEN [] ELSE [pid] END, list_transform(fresh, lambda x: x.v)) AS shape_ids,
      CASE WHEN in_path IS NOT NULL THEN 'pathname' WHEN in_q IS NOT NULL THEN 'search_param' END AS id_location,
      CASE WHEN in_path IS NOT NULL THEN in_path.f WHEN in_q IS NULL THEN 'unknown' WHEN regexp_matches(in_q.v, {num}) THEN 'numeric' ELSE 'alphanumeric' END AS id_format,
      CASE WHEN in_path IS NOT NULL THEN in_path.c WHEN in_q IS NULL THEN 'low' ELSE 'high' END AS id_confidence,
      cast(in_path.e AS bigint) AS id_from_end, in_q.p AS id_param, in_path.x AS id_prefix,
      CASE WHEN m_err IS NOT NULL THEN 'Failed to parse URL' WHEN pid IS NULL THEN 'No pattern identified'
        ELSE coalesce(in_path.d, 'value of parameter "' || in_q.p || '" (' || in_q.v || ')') || array_to_string(list_transform(fresh, lambda x: ' + ' || x.p || ' param'), '') END AS id_description
    FROM (SELECT *, list_filter(ex, lambda x, i: (pid IS NULL OR x.v <> pid) AND list_position(list_transform(ex, lambda y: y.v), x.v) = i) AS fresh
    FROM (SELECT *, coalesce(in_path.id, in_q.id) AS pid,
        CASE WHEN m_err IS NULL THEN list_filter([{extra}], lambda x: regexp_matches(x.v, {num})) ELSE [] END AS ex
    FROM (SELECT *, CASE WHEN in_path IS NULL AND m_err IS NULL THEN coalesce({by_param}) END AS in_q
    FROM (SELECT *, coalesce({', '.join(cand)}) AS in_path
    FROM (SELECT *, CASE WHEN m_err IS NULL THEN list_filter(string_split(m_path, '/'), lambda s: s <> '') ELSE [] END AS segs FROM ({mined}) h1) h2) h3) h4) h5) h6"""


SHAPES = shape_sql(MINED)

_COVERAGE = f"""shapes AS ({SHAPES}),
    keyed AS (SELECT regexp_replace(host, '^www\\.', '') AS domain, CASE WHEN len(shape_ids) > 0 THEN id_location END AS loc, * FROM shapes WHERE m_err IS NULL),
    totals AS (SELECT domain, count(*) AS total FROM keyed GROUP BY domain),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, loc, id_from_end, id_param, id_format ORDER BY url_id) AS rn FROM keyed WHERE loc IS NOT NULL),
    coverage AS (SELECT domain, loc AS id_location, id_from_end, id_param, id_format, count(*) AS url_count, any_value(total) AS total,
        array_to_string(list(m_url ORDER BY rn) FILTER (rn <= 3), '|') AS example_urls,
        CASE WHEN min(id_prefix) = max(id_prefix) THEN min(id_prefix) END AS common_prefix
      FROM ranked JOIN totals USING (domain) GROUP BY ALL HAVING true),
    grouped AS (SELECT domain, id_location, id_from_end, id_param, id_format, url_count, url_count / total AS coverage, example_urls, common_prefix,
        coalesce(lower(id_param) IN {text_list(GENERIC_PARAMS)}, false) AS covered_by_generic FROM coverage),
    suggested AS (SELECT *, CASE WHEN id_location = 'pathname' THEN
        CASE WHEN id_format = 'prefixed' AND common_prefix IS NOT NULL THEN lower(common_prefix) || '(\\d+)' WHEN id_format = 'numeric' THEN '/(\\d{{4,}})(?:/|$)'
          WHEN id_format = 'alphanumeric' THEN '(?i)/([a-z0-9]{{6,}})(?:/|$)' ELSE '(?i)/([a-z0-9-]+)(?:/|$)' END
        ELSE '(?i)' || id_param || CASE WHEN id_format = 'numeric' THEN '=(\\d+)' ELSE '=([a-z0-9]+)' END END AS regex
      FROM grouped WHERE NOT covered_by_generic)"""


def _valid(columns: str) -> str:
    return f"SELECT url_id, {columns} FROM ({COMP}) WHERE err IS NULL"


_BY_RULES = f"""WITH lines AS (SELECT lower(regexp_extract(rule, '^[ ]*([^ ]*)', 1)) AS l FROM ({view_sql("suffix_list")})),
    rules AS (SELECT DISTINCT regexp_replace(l, '^(!|[*][.])', '') AS key, starts_with(l, '!') AS spared, starts_with(l, '*.') AS wild FROM lines WHERE l NOT IN ('', '*') AND NOT starts_with(l, '//')),
    urls AS (SELECT url_id, url FROM ({ALL_URLS}) UNION ALL SELECT 'host-' || c_custkey || '-' || form, url FROM ({view_sql("suffix_hosts")})),
    valid AS (SELECT url_id, hostname, string_split(hostname, '.') AS ls FROM ({components_sql("SELECT * FROM urls")}) WHERE err IS NULL),
    hosts AS (SELECT DISTINCT hostname, ls FROM valid),
    tails AS (SELECT hostname, ls, n, array_to_string(ls[len(ls) - n + 1:], '.') AS tail FROM hosts, range(1, 200) t(n) WHERE n <= len(ls)),
    met AS (SELECT hostname, spared, n + CASE WHEN spared THEN -1 WHEN wild THEN 1 ELSE 0 END AS size FROM tails JOIN rules ON tail = key WHERE NOT wild OR n < len(ls)),
    best AS (SELECT hostname, arg_max(size, size + CASE WHEN spared THEN 1000 ELSE 0 END) AS size FROM met GROUP BY hostname),
    based AS (SELECT url_id, v.hostname, ls, CASE WHEN regexp_matches(v.hostname, '^[0-9.]+$') THEN v.hostname
        ELSE array_to_string(ls[greatest(len(ls) - coalesce(size, 1), 1):], '.') END AS base FROM valid v LEFT JOIN best b ON b.hostname = v.hostname),
    branded AS (SELECT *, list_filter(string_split(substr(hostname, 1, greatest(length(hostname) - length(base) - 1, 0)), '.'), lambda b: b IN {text_list(BRAND_SUBDOMAINS)})[1] AS brand FROM based)
    SELECT url_id, hostname, CASE WHEN brand IS NOT NULL AND NOT starts_with(base, brand || '.') THEN brand || '.' || base ELSE base END AS domain FROM branded"""

ORACLE: dict[str, str] = {
    "url_domain_by_rules": _BY_RULES,
    "url_validate": f"""SELECT url_id, err IS NULL AS is_valid, err AS error,
        CASE WHEN err IS NULL THEN NULL WHEN coalesce(url, '') = '' THEN 'URL must be a non-empty string'
          WHEN sch = '' OR sch IN ('http', 'https') THEN 'Invalid URL format: ' || u
          ELSE 'Invalid protocol: ' || sch || ':. Only HTTP(S) protocols are allowed' END AS message FROM ({PARTS})""",
    "url_public_filter": f"""SELECT url_id, host FROM ({PARTS}) WHERE err IS NULL AND host NOT IN ('localhost', '127.0.0.1', '0.0.0.0', '::1', '[::1]')
        AND NOT regexp_matches(host, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|169\\.254\\.)')""",
    "url_normalize": _valid("href"),
    "url_strip_tracking": _valid("search"),
    "url_domain": _valid("hostname, domain"),
    "url_key": _valid("key"),
    "url_components": _valid("href, url_encode(href) AS encoded_href, hostname, pathname, search, domain, key, url AS original"),
    "url_dedup": f"""SELECT key, min_by(href, url_id) AS href, min(url_id) AS url_id, count(*) AS copies FROM ({COMP}) WHERE err IS NULL GROUP BY key""",
    "extract_store_path_ids": _with(IDS, f"SELECT url_id, {_j('store_ids')} AS ids FROM final"),
    "extract_generic_path_ids": _with(IDS, f"SELECT url_id, {_j('gen_path')} AS ids FROM final WHERE len(store_ids) = 0"),
    "extract_store_query_ids": _with(IDS, f"SELECT url_id, {_j('store_query')} AS ids FROM final"),
    "extract_generic_query_ids": _with(IDS, f"SELECT url_id, {_j('gen_query')} AS ids FROM final"),
    "transform_ids": _with(IDS, f"SELECT url_id, {_j('raw_store')} AS raw_ids, {_j('store_ids')} AS ids FROM final WHERE find IS NOT NULL"),
    "finalize_ids": _with(IDS, f"SELECT url_id, {_j('ids')} AS ids, ids_ok AS is_valid FROM final"),
    "url_analysis": _with(IDS + ", " + _ANALYSIS, "SELECT * FROM analysis"),
    "url_analysis_summary": _with(
        IDS + ", " + _ANALYSIS,
        "SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM analysis",
    ),
    "image_sku_ids": f"""SELECT session_id, item_pos, array_to_string(coalesce(regexp_extract_all(split_part(image_url, '/', -1), '([A-Z][A-Z0-9]{{3,9}})[-_.]', 1), []), '|') AS ids
        FROM ({view_sql("cart_lines")})""",
    "golden_url_check": _with(
        ids_sql(f"SELECT case_id AS url_id, store_name, url, store_id, expected_skus FROM ({view_sql('golden_urls')})"),
        """, checked AS (SELECT store_name, list_sort(list_transform(expected_skus, lambda x: lower(x))) = ids AS passed FROM final)
        SELECT store_name, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM checked GROUP BY store_name""",
    ),
    "mining_url_normalize": f"SELECT url_id, m_url FROM ({MINED})",
    "non_product_filter": f"""SELECT url_id, {_rule_chain(1)} AS reject_reason, {_rule_chain(2)} AS reject_explanation
        FROM (SELECT *, regexp_replace(host, '^www\\.', '') AS bare FROM ({MINED}) WHERE url IS NOT NULL)""",
    "mining_dedup": f"SELECT min(url_id) AS url_id, m_url FROM ({MINED}) WHERE url IS NOT NULL GROUP BY m_url",
    "analyze_url_shape": f"SELECT url_id, {_j('shape_ids')} AS shape_ids, id_location, id_format, id_confidence, id_from_end, id_param, id_description FROM ({SHAPES})",
    "url_pattern_coverage": _with(
        _COVERAGE,
        """SELECT domain, id_location, id_from_end, id_param, id_format, url_count, round(coverage, 6) AS coverage,
        CASE WHEN coverage >= 0.8 THEN 'high' WHEN coverage >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, example_urls, covered_by_generic FROM grouped""",
    ),
    "urls_without_pattern": f"SELECT url_id, url FROM ({SHAPES}) WHERE len(shape_ids) = 0",
    "suggest_patterns": _with(_COVERAGE, "SELECT domain, id_location, id_param, id_format, regex FROM suggested"),
    "evaluate_candidate_patterns": _with(
        _COVERAGE,
        """, rules AS (SELECT DISTINCT domain, id_location, regex FROM suggested),
        tried AS (SELECT r.*, k.shape_ids[1] AS mined, regexp_extract_all(CASE WHEN r.id_location = 'pathname' THEN k.m_path ELSE '?' || k.q END, r.regex, 1) AS hits
          FROM keyed k JOIN rules r USING (domain))
        SELECT domain, id_location, regex, count(*) AS urls, count(*) FILTER (len(hits) > 0) AS matched,
          count(*) FILTER (list_contains(list_transform(hits, lambda h: lower(h)), mined)) AS agreed,
          round(count(*) FILTER (list_contains(list_transform(hits, lambda h: lower(h)), mined)) / count(*), 6) AS hit_rate
        FROM tried GROUP BY domain, id_location, regex""",
    ),
    "validate_store_rows": f"""SELECT pos, r.id, domain, CASE WHEN coalesce(trim(r.id), '') = '' THEN 'Store ID cannot be empty' WHEN NOT regexp_full_match(r.id, '[0-9]+') THEN 'Store ID must be numeric (e.g., "5246")' END AS id_error,
        CASE WHEN regexp_full_match(domain, '[a-z0-9]+(\\.[a-z0-9]+)+') THEN NULL ELSE 'Invalid' END AS domain_error, c.name AS catalog_name
        FROM ({view_sql("store_registry")}) r LEFT JOIN ({view_sql("store_catalog")}) c ON r.id = cast(c.id AS varchar)""",
}
