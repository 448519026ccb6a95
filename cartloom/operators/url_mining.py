"""Mining of URL logs for the place and shape of product ids, and rules suggested from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.text import js_trim
from cartloom.functions.urls import settled, with_url_parts

# URLs that are not product pages, in the order the rules are tried.
NON_PRODUCT_RULES = [
    (r"/cart\b", "cart", "Shopping cart URL"),
    (r"/basket\b", "cart", "Shopping basket URL"),
    (r"/checkout\b", "checkout", "Checkout URL"),
    (r"/payment\b", "checkout", "Payment page URL"),
    (r"/order\b", "checkout", "Order page URL"),
    (r"/account\b", "account", "Account page URL"),
    (r"/login\b", "login", "Login page URL"),
    (r"/signin\b", "login", "Sign in page URL"),
    (r"/register\b", "account", "Registration page URL"),
    (r"/signup\b", "account", "Sign up page URL"),
    (r"/my-account\b", "account", "My account page URL"),
    (r"/profile\b", "account", "Profile page URL"),
    (r"^https?://[^/]+/?$", "homepage", "Homepage URL"),
    (r"/home/?$", "homepage", "Homepage URL"),
    (r"/landing\b", "homepage", "Landing page URL"),
    (r"/search\b", "search", "Search results URL"),
    (r"[?&]q=", "search", "Search query URL"),
    (r"[?&]query=", "search", "Search query URL"),
    (r"[?&]search=", "search", "Search query URL"),
    (r"/help\b", "other", "Help page URL"),
    (r"/faq\b", "other", "FAQ page URL"),
    (r"/contact\b", "other", "Contact page URL"),
    (r"/about\b", "other", "About page URL"),
    (r"/privacy\b", "other", "Privacy page URL"),
    (r"/terms\b", "other", "Terms page URL"),
    (r"/store-locator\b", "other", "Store locator URL"),
    (r"/stores?/?$", "other", "Stores page URL"),
    (r"/customer-service\b", "other", "Customer service page URL"),
    (r"/support\b", "other", "Support page URL"),
    (r"/shipping\b", "other", "Shipping info page URL"),
    (r"/returns\b", "other", "Returns page URL"),
    (r"/gift-cards?\b", "other", "Gift card page URL"),
    (r"/rewards\b", "other", "Rewards page URL"),
    (r"/sitemap\b", "other", "Sitemap URL"),
]

# Shapes and names that mark product ids.
PRODUCT_SEGMENT = r"(?i)^(p|product|item|dp|pd|sku|prod|products?|items?)$"
NUMERIC = r"^\d{4,}$"
ALPHANUMERIC = r"(?i)^[a-z0-9]{6,}$"
PREFIXED = r"(?i)^([a-z]{1,4}[-_])(\d{4,}|[a-z0-9]{6,})$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ID_PARAMS = ["skuid", "sku", "id", "productid", "product_id", "item_id", "itemid", "pid"]
SECONDARY_PARAMS = [
    "variationproductcode", "variantid", "variant_id", "colorid", "color_id", "sizeid", "size_id", "skuid", "sku",
]
GENERIC_PARAMS = [
    "sku", "pid", "id", "productid", "product_id", "skuid", "athcpid", "upc_id", "variant", "prdtno", "item_id", "itemid",
]
DOMAIN_FORM = r"(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"
SAMPLE = 3


def mining_url_normalize(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``m_url`` (https where no scheme is given, host and path lower-cased, one trailing slash dropped), ``m_valid``,
    ``m_host``, ``m_path`` and ``m_query``. Unparsable URLs are only trimmed and lower-cased."""
    text = js_trim(F.col(url_col))
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    parts = with_url_parts(df.withColumn("m_input", full), "m_input")
    ok = F.col("u_error").isNull()
    path = F.when(F.col("u_path") == "", F.lit("/")).otherwise(F.lower("u_path"))
    default_port = F.when(F.col("u_scheme") == "https", F.lit("443")).otherwise(F.lit("80"))
    port = F.when((F.col("u_port") == "") | (F.col("u_port") == default_port), F.lit("")).otherwise(F.concat(F.lit(":"), "u_port"))
    tail = F.expr("substring(u_text, length(substring_index(substring_index(u_text, '#', 1), '?', 1)) + 1)")
    out = parts.withColumns(
        {
            "m_valid": ok,
            "m_host": F.when(ok, F.col("u_host")),
            "m_path": F.when(ok, F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)),
            "m_query": F.when(ok, F.col("u_query")),
        }
    ).withColumn(
        "m_url",
        F.when(ok, F.concat("u_scheme", F.lit("://"), "m_host", port, "m_path", tail)).otherwise(F.lower(text)),
    )
    return out.select(*df.columns, "m_url", "m_valid", "m_host", "m_path", "m_query")


def bare_domain(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def non_product_filter(df: DataFrame, url_col: str = "url", domain_col: str | None = None) -> DataFrame:
    """Adds ``reject_reason`` and ``reject_explanation``; both null for product pages.

    One alternation over all rules decides for most URLs that none applies; only hits walk through the ordered rules.
    """
    marked = mining_url_normalize(df, url_col)
    any_rule = F.col("m_url").rlike("(?i)" + "|".join(f"(?:{p})" for p, _, _ in NON_PRODUCT_RULES))
    reason, explanation = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, why, text in reversed(NON_PRODUCT_RULES):
        hit = F.col("m_url").rlike("(?i)" + pattern)
        reason = F.when(hit, F.lit(why)).otherwise(reason)
        explanation = F.when(hit, F.lit(text)).otherwise(explanation)
    reason, explanation = F.when(any_rule, reason), F.when(any_rule, explanation)
    if domain_col:
        want = bare_domain(F.col(domain_col))
        got = bare_domain(F.col("m_host"))
        asked = F.coalesce(F.col(domain_col), F.lit("")) != ""
        invalid = asked & ~F.col("m_valid")
        differs = asked & F.col("m_valid") & ~F.contains(got, want) & ~F.contains(want, got)
        reason = F.when(invalid | differs, F.lit("other")).otherwise(reason)
        explanation = (
            F.when(invalid, F.lit("Invalid URL format"))
            .when(differs, F.concat(F.lit("Domain mismatch: expected "), want, F.lit(", got "), got))
            .otherwise(explanation)
        )
    return marked.withColumn("reject_reason", reason).withColumn("reject_explanation", explanation)


def mining_dedup(df: DataFrame, order_col: str, url_col: str = "url") -> DataFrame:
    """First row per normalised URL."""
    w = Window.partitionBy("m_url").orderBy(order_col)
    return mining_url_normalize(df, url_col).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _segment_candidate(back: int) -> Column:
    """What the segment ``back`` places from the end tells about the id."""
    seg = F.col(f"seg{back}")
    after_marker = F.coalesce(F.col(f"seg{back + 1}").rlike(PRODUCT_SEGMENT), F.lit(False))
    place = (F.col("seg_count") - back).cast("string")

    def found(ident: Column, fmt: str, confidence: Column, text: Column, prefix: Column | None = None) -> Column:
        return F.struct(
            ident.alias("id"),
            F.lit(fmt).alias("format"),
            F.lit(back).alias("from_end"),
            confidence.alias("confidence"),
            text.alias("description"),
            (prefix if prefix is not None else F.lit(None).cast("string")).alias("prefix"),
        )

    prefix = F.regexp_extract(seg, PREFIXED, 1)
    return (
        F.when(
            seg.rlike(NUMERIC),
            found(
                seg,
                "numeric",
                F.when(after_marker, F.lit("high")).otherwise(F.lit("medium")),
                F.concat(F.lit("number in path segment "), place, F.lit(" ("), seg, F.lit(")")),
            ),
        )
        .when(
            seg.rlike(PREFIXED),
            found(
                F.lower(F.regexp_extract(seg, PREFIXED, 2)),
                "prefixed",
                F.lit("high"),
                F.concat(F.lit('prefix "'), F.regexp_replace(prefix, "[-_]$", ""), F.lit('" before a number in the path ('), seg, F.lit(")")),
                prefix,
            ),
        )
        .when(
            seg.rlike(UUID),
            found(F.lower(seg), "uuid", F.lit("medium"), F.concat(F.lit("uuid in path segment "), place)),
        )
        .when(
            after_marker & seg.rlike(ALPHANUMERIC),
            found(
                F.lower(seg),
                "alphanumeric",
                F.lit("high"),
                F.concat(F.lit("code after a product word in the path ("), seg, F.lit(")")),
            ),
        )
    )


def _param_value(name: str, last_any_case: bool = False) -> Column:
    rule = rf"(?is)^.*(?:^|&){name}=([^&]*)" if last_any_case else rf"(?:^|&){name}=([^&]*)"
    asked = F.contains("lower_query" if last_any_case else "m_query", F.lit(f"{name}="))
    raw = F.when(asked, F.regexp_extract("m_query", rule, 1))
    return F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)


def analyze_url_shape(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``shape_ids, id_location, id_format, id_confidence, id_from_end, id_param, id_prefix, id_description``.

    The last three path segments are tried from the end; then the id parameters; then secondary parameters add their ids.
    """
    base = mining_url_normalize(df, url_col).withColumn("segs", F.filter(F.split("m_path", "/"), lambda s: s != ""))
    base = base.withColumn("seg_count", F.size("segs"))
    base = base.withColumns({f"seg{back}": F.try_element_at("segs", F.lit(-1 - back)) for back in range(4)})
    has_query = F.col("m_query") != ""
    base = base.withColumn("lower_query", F.lower("m_query")).withColumns(
        {f"first_{p}": _param_value(p) for p in ID_PARAMS} | {f"last_{p}": _param_value(p, True) for p in SECONDARY_PARAMS}
    )
    by_param = [
        F.when(
            F.col(f"first_{p}").rlike(NUMERIC) | F.col(f"first_{p}").rlike(ALPHANUMERIC),
            F.struct(F.lower(f"first_{p}").alias("id"), F.lit(p).alias("param"), F.col(f"first_{p}").alias("value")),
        )
        for p in ID_PARAMS
    ]
    second = {p: F.when(F.col(f"last_{p}").rlike(NUMERIC), F.col(f"last_{p}")) for p in SECONDARY_PARAMS}
    found = (
        base.withColumn("in_path", F.coalesce(*[_segment_candidate(b) for b in range(3)]))
        .withColumn("in_query", F.when(F.col("in_path").isNull() & has_query, F.coalesce(*by_param)))
        .withColumn("id_location", F.when(F.col("in_path").isNotNull(), F.lit("pathname")).when(F.col("in_query").isNotNull(), F.lit("search_param")))
        .withColumn("primary_id", F.coalesce("in_path.id", "in_query.id"))
        .withColumn(
            "extra",
            F.when(
                has_query,
                F.filter(
                    F.array(*[F.struct(F.lit(p).alias("p"), v.alias("v")) for p, v in second.items()]),
                    lambda x: x["v"].isNotNull(),
                ),
            ).otherwise(F.expr("cast(array() as array<struct<p: string, v: string>>)")),
        )
    )
    found = settled(
        found.select(*df.columns, "m_url", "m_valid", "m_host", "m_path", "m_query", "in_path", "in_query", "id_location", "primary_id", "extra"),
        "in_path", "in_query", "id_location", "primary_id", "extra",
    )
    extra_values = F.transform("extra", lambda x: x["v"])
    fresh = F.filter(
        "extra",
        lambda x, i: (F.array_position(extra_values, x["v"]) == i + 1) & ~x["v"].eqNullSafe(F.col("primary_id")),
    )
    named = F.array_join(F.transform("fresh", lambda x: F.concat(F.lit(" + "), x["p"], F.lit(" param"))), "")
    query_format = F.when(F.col("in_query.value").rlike(NUMERIC), F.lit("numeric")).otherwise(F.lit("alphanumeric"))
    described = F.coalesce(
        F.col("in_path.description"),
        F.concat(F.lit('value of parameter "'), "in_query.param", F.lit('" ('), "in_query.value", F.lit(")")),
    )
    out = found.withColumn("fresh", fresh)
    return out.select(
        *df.columns,
        "m_url",
        "m_valid",
        "m_host",
        "m_path",
        "m_query",
        F.concat(
            F.when(F.col("primary_id").isNotNull(), F.array("primary_id")).otherwise(F.expr("cast(array() as array<string>)")),
            F.transform("fresh", lambda x: x["v"]),
        ).alias("shape_ids"),
        "id_location",
        F.coalesce(F.col("in_path.format"), F.when(F.col("in_query").isNotNull(), query_format), F.lit("unknown")).alias("id_format"),
        F.coalesce(F.col("in_path.confidence"), F.when(F.col("in_query").isNotNull(), F.lit("high")), F.lit("low")).alias("id_confidence"),
        F.col("in_path.from_end").alias("id_from_end"),
        F.col("in_query.param").alias("id_param"),
        F.col("in_path.prefix").alias("id_prefix"),
        F.when(~F.col("m_valid"), F.lit("Failed to parse URL"))
        .when(described.isNull(), F.lit("No pattern identified"))
        .otherwise(F.concat(described, named))
        .alias("id_description"),
    )


def shape_ids(df: DataFrame, url_col: str, out_col: str) -> DataFrame:
    """Adds only the ids that ``analyze_url_shape`` finds; no URL gives an empty array."""
    return analyze_url_shape(df, url_col).select(
        *df.columns, F.coalesce("shape_ids", F.expr("cast(array() as array<string>)")).alias(out_col)
    )


_PATTERN_KEY = ["domain", "id_location", "id_from_end", "id_param", "id_format"]


def url_pattern_coverage(shapes: DataFrame, order_col: str) -> DataFrame:
    """Per domain and id pattern: number and share of URLs, confidence by share, three example URLs.

    Examples come from a ranked filter, which keeps at most three rows per pattern and task before anything is shuffled.
    """
    located = shapes.withColumn("domain", bare_domain(F.col("m_host"))).where(F.col("domain").isNotNull())
    usable = F.when((F.size("shape_ids") > 0) & F.col("id_location").isNotNull(), F.col("id_location"))
    keyed = located.withColumn("id_location", usable)
    keyed = keyed.select(
        *[(F.when(usable.isNotNull(), F.col(k)).alias(k) if k.startswith("id_") and k != "id_location" else F.col(k)) for k in _PATTERN_KEY],
        "m_url",
        "id_prefix",
        F.col(order_col).alias("o"),
    )
    counts = keyed.groupBy(*_PATTERN_KEY).agg(
        F.count(F.lit(1)).alias("url_count"), F.min("id_prefix").alias("p_min"), F.max("id_prefix").alias("p_max")
    )
    totals = counts.groupBy("domain").agg(F.sum("url_count").alias("total_urls"))
    w = Window.partitionBy(*_PATTERN_KEY).orderBy("o")
    examples = (
        keyed.where(F.col("id_location").isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= SAMPLE)
        .groupBy(*_PATTERN_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "m_url")))["m_url"].alias("example_urls"))
    )
    coverage = F.col("url_count") / F.col("total_urls")
    joined = (
        counts.where(F.col("id_location").isNotNull())
        .join(totals, "domain")
        .alias("c")
        .join(examples.alias("e"), [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in _PATTERN_KEY])
    )
    return joined.select(
        *[F.col(f"c.{k}").alias(k) for k in _PATTERN_KEY],
        "url_count",
        "total_urls",
        coverage.alias("coverage"),
        F.when(coverage >= 0.8, F.lit("high")).when(coverage >= 0.5, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"),
        "example_urls",
        F.coalesce(F.lower("c.id_param").isin(GENERIC_PARAMS), F.lit(False)).alias("covered_by_generic"),
        F.when(F.col("p_min") == F.col("p_max"), F.col("p_min")).alias("common_prefix"),
    )


def urls_without_pattern(shapes: DataFrame) -> DataFrame:
    return shapes.where(F.size("shape_ids") == 0)


def suggest_patterns(coverage: DataFrame) -> DataFrame:
    """One candidate regex per mined pattern; query parameters that the generic rule already reads are left out."""
    path_regex = (
        F.when(
            (F.col("id_format") == "prefixed") & F.col("common_prefix").isNotNull(),
            F.concat(F.lower("common_prefix"), F.lit(r"(\d+)")),
        )
        .when(F.col("id_format") == "numeric", F.lit(r"/(\d{4,})(?:/|$)"))
        .when(F.col("id_format") == "alphanumeric", F.lit(r"(?i)/([a-z0-9]{6,})(?:/|$)"))
        .otherwise(F.lit(r"(?i)/([a-z0-9-]+)(?:/|$)"))
    )
    query_regex = F.when(
        F.col("id_format") == "numeric", F.concat(F.lit("(?i)"), "id_param", F.lit(r"=(\d+)"))
    ).otherwise(F.concat(F.lit("(?i)"), "id_param", F.lit("=([a-z0-9]+)")))
    return coverage.where(~F.col("covered_by_generic")).select(
        *_PATTERN_KEY,
        "coverage",
        "confidence",
        F.when(F.col("id_location") == "pathname", path_regex).otherwise(query_regex).alias("regex"),
    )


def evaluate_candidate_patterns(shapes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """How often each suggested regex finds the mined id again on the URLs of its domain."""
    urls = shapes.select(
        bare_domain(F.col("m_host")).alias("domain"), "m_path", "m_query", F.get("shape_ids", F.lit(0)).alias("mined")
    ).where(F.col("domain").isNotNull())
    rules = suggestions.select("domain", "id_location", "regex").distinct()
    tried = urls.join(rules, "domain").withColumn(
        "hits",
        F.regexp_extract_all(
            F.when(F.col("id_location") == "pathname", F.col("m_path")).otherwise(F.concat(F.lit("?"), "m_query")),
            F.col("regex"),
            F.lit(1),
        ),
    )
    lowered = F.transform("hits", lambda h: F.lower(h))
    return (
        tried.groupBy("domain", "id_location", "regex")
        .agg(
            F.count(F.lit(1)).alias("urls"),
            F.count_if(F.size("hits") > 0).alias("matched"),
            F.count_if(F.coalesce(F.array_contains(lowered, F.col("mined")), F.lit(False))).alias("agreed"),
        )
        .withColumn("hit_rate", F.col("agreed") / F.col("urls"))
    )


def validate_store_rows(stores: DataFrame, catalog: DataFrame) -> DataFrame:
    """Checks id and domain of store rows and looks their name up in the catalog."""
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace("domain", "^https?://", ""), r"^www\.", ""), "/$", "")

    def empty(c: str) -> Column:
        return F.coalesce(js_trim(F.col(c)), F.lit("")) == ""

    names = catalog.select(F.col("id").cast("string").alias("catalog_id"), F.col("name").alias("catalog_name"))
    return (
        stores.withColumn(
            "id_error",
            F.when(empty("id"), F.lit("Store ID cannot be empty")).when(
                ~F.col("id").rlike(r"^\d+$"), F.lit('Store ID must be numeric (e.g., "5246")')
            ),
        )
        .withColumn(
            "domain_error",
            F.when(empty("domain"), F.lit("Domain cannot be empty")).when(
                ~cleaned.rlike(DOMAIN_FORM),
                F.concat(F.lit('Invalid domain format: "'), "domain", F.lit('". Expected format: example.com')),
            ),
        )
        .join(names, F.col("id") == F.col("catalog_id"), "left")
        .drop("catalog_id")
    )
