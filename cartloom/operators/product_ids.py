"""Product identifiers mined from URLs with store rules and generic rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.urls import PUBLIC_SUFFIXES, Get, Steps, domain_steps, host_steps, over_elements, part_steps, path_steps, query_steps, with_steps, with_url_components
from cartloom.sources.registry import SETTINGS, settings_by_key, store_lookup

# Generic identifier patterns and limits.
MAX_IDS = 12
VALID_ID = r"^[\w-]{1,24}$"
GENERIC_PATH_PATTERNS = [r"\b((?:prod|prd|p)-?(\d{6,24}))\b", r"\b(?:/|-)(\d{6,24})(?:\.html)?$"]
GENERIC_QUERY_PATTERN = r"[?&](?:sku|pid|id|productid|skuid|athcpid|upc_id|variant|prdtno)=([\w-]{4,24})"

_NONE = "cast(array() as array<string>)"


def _capped(ids: Column) -> Column:
    return F.slice(F.array_distinct(ids), 1, MAX_IDS)


def pattern_ids(text: Column, regex: Column, groups: Column) -> Column:
    """Distinct lower-cased captures of the first two groups, in match order."""
    first = F.regexp_extract_all(text, regex, F.lit(1))
    second = F.regexp_extract_all(text, F.concat(regex, F.lit("()")), F.lit(2))
    both = F.when(groups >= 2, F.flatten(F.zip_with(first, second, lambda a, b: F.array(a, b)))).otherwise(first)
    return _capped(F.filter(both, lambda x: x != ""))


def _group_count(regex: Column) -> Column:
    return F.regexp_count(regex, F.lit(r"(?<!\\)\((?!\?)"))


def store_pattern_ids(text: Column, patterns: Column) -> Column:
    """Captures of all patterns of the row's store, in pattern order; empty for rows without patterns."""
    found = F.flatten(F.transform(patterns, lambda p: pattern_ids(text, p, _group_count(p))))
    return F.when(F.size(F.coalesce(patterns, F.expr(_NONE))) > 0, found).otherwise(F.expr(_NONE))


def rewrite_ids(ids: Column, find: Column, to: Column) -> Column:
    """Rewrites the first hit of the store's find pattern in every id."""
    once = F.concat(F.lit("^(.*?)(?:"), F.regexp_replace(find, r"^\^", ""), F.lit(")"))
    anchored = F.concat(F.lit("^()(?:"), F.regexp_replace(find, r"^\^", ""), F.lit(")"))
    rule = F.when(find.startswith("^"), anchored).otherwise(once)
    return F.when(
        find.isNotNull(), F.transform(ids, lambda x: F.regexp_replace(x, rule, F.concat(F.lit("$1"), to)))
    ).otherwise(ids)


def generic_path_ids(path: Column) -> Column:
    return _capped(
        F.concat(
            *[pattern_ids(path, F.lit(p), F.lit(p.count("(") - p.count("(?"))) for p in GENERIC_PATH_PATTERNS]
        )
    )


def generic_query_ids(query: Column) -> Column:
    return pattern_ids(query, F.lit(GENERIC_QUERY_PATTERN), F.lit(1))


def with_product_ids(df: DataFrame, registry: DataFrame, store_col: str | None = "store_id") -> DataFrame:
    """Adds ``resolved_store_id``, ``found_ids`` and ``id_error`` to a table with URL components.

    ``found_ids`` is sorted and holds at most twelve ids. A malformed id fails the whole URL.
    """
    base = df if store_col else df.withColumn("no_store", F.lit(None).cast("string"))
    found = with_steps(store_lookup(base, registry, store_col or "no_store"), id_steps()).withColumnRenamed("primary_id", "resolved_store_id")
    return found.drop("no_store", "store_pos", "primary_domain", *SETTINGS)


def id_steps() -> Steps:
    """``found_ids`` and ``id_error`` from ``pathname``, ``search`` and the settings of the store."""

    def store_path_ids(g: Get) -> Column:
        return _capped(rewrite_ids(store_pattern_ids(F.lower(g("pathname")), g("path_patterns")), g("rewrite_find"), g("rewrite_to")))

    def query_ids(g: Get) -> Column:
        query = F.lower(g("search"))
        return F.when(g("search") == "", F.expr(_NONE)).otherwise(F.concat(store_pattern_ids(query, g("query_patterns")), generic_query_ids(query)))

    return [
        ("store_path_ids", store_path_ids),
        ("path_ids", lambda g: F.when(F.size(g("store_path_ids")) > 0, g("store_path_ids")).otherwise(generic_path_ids(F.lower(g("pathname"))))),
        ("query_ids", query_ids),
        ("found_ids", lambda g: F.array_sort(_capped(F.concat(g("path_ids"), g("query_ids"))))),
        ("id_error", lambda g: F.when(F.exists(g("found_ids"), lambda x: ~x.rlike(VALID_ID)), F.lit("ZodError"))),
    ]


def nested_ids(urls: Column, store_id: Column, registry: DataFrame, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column | None:
    """The ids of every URL of a list, as a list of lists in its order, worked out within the row: no explode, no join, so it suits streams.
    Failures and missing URLs give an empty list. None where the registry is too large to go into the expression."""
    settings = settings_by_key(registry)
    if settings is None:
        return None
    by_id, by_domain = settings
    given = F.nullif(store_id, F.lit(""))

    def fields(e: Column, *names: str) -> Column:
        return F.transform(e, lambda x: F.struct(*[x[n].alias(n) for n in names]))

    def of_store(g: Get) -> Column:
        return F.when(given.isNotNull(), F.try_element_at(by_id, given)).otherwise(F.try_element_at(by_domain, g("domain")))

    found = over_elements(F.transform(urls, lambda u: F.struct(u.alias("u"))), [*part_steps(lambda g: g("u")), *host_steps()])
    found = fields(found, "u_error", "u_path", "u_query", "hostname")
    found = over_elements(found, [*path_steps(), *query_steps(), *domain_steps(suffixes)])
    found = over_elements(fields(found, "u_error", "pathname", "search", "domain"), [("store", of_store)])
    found = F.transform(found, lambda x: F.struct(x["u_error"].alias("u_error"), x["pathname"].alias("pathname"), x["search"].alias("search"), *[x["store"][n].alias(n) for n in SETTINGS]))
    found = over_elements(found, id_steps())
    return F.transform(found, lambda x: F.coalesce(F.when(x["u_error"].isNull() & x["id_error"].isNull(), x["found_ids"]), F.expr(_NONE)))


def url_analysis(
    urls: DataFrame, registry: DataFrame, url_col: str = "url", store_col: str | None = "store_id", suffixes: Iterable[str] | DataFrame = PUBLIC_SUFFIXES
) -> DataFrame:
    """Identifiers per URL: ``store_id, product_ids, count, success, error, message`` next to the input columns."""
    kept = [c for c in urls.columns if c != store_col]
    found = with_product_ids(with_url_components(urls, url_col, suffixes), registry, store_col)
    failed = F.coalesce(F.col("error"), F.col("id_error"))
    ok = failed.isNull()
    return found.select(
        *kept,
        F.when(ok, F.col("resolved_store_id")).alias("store_id"),
        F.when(ok, F.col("found_ids")).alias("product_ids"),
        F.when(ok, F.size("found_ids")).alias("count"),
        ok.alias("success"),
        failed.alias("error"),
        F.coalesce(F.col("message"), F.when(~ok, F.lit("Invalid product id"))).alias("message"),
    )


def extracted_ids(df: DataFrame, registry: DataFrame, url_col: str, store_col: str, out_col: str, suffixes: Iterable[str] | DataFrame = PUBLIC_SUFFIXES) -> DataFrame:
    """Adds the ids of a URL column; failures and missing URLs give an empty array."""
    found = with_product_ids(with_url_components(df, url_col, suffixes), registry, store_col)
    usable = F.col("error").isNull() & F.col("id_error").isNull()
    return found.select(
        *df.columns, F.coalesce(F.when(usable, F.col("found_ids")), F.expr(_NONE)).alias(out_col)
    )


def result_summary(results: DataFrame, products_col: str | None = None) -> DataFrame:
    """Total, successful and failed rows of a job, and the number of products where the job yields several per row."""
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    ]
    if products_col:
        aggs.append(F.coalesce(F.sum(products_col), F.lit(0)).cast("long").alias("total_products"))
    return results.agg(*aggs)


def golden_url_check(golden: DataFrame, registry: DataFrame) -> DataFrame:
    """Expected against found ids, row by row: compared lower-cased and sorted."""
    results = url_analysis(golden, registry, "url", "store_id")
    expected = F.array_sort(F.transform("expected_skus", lambda x: F.lower(x)))
    actual = F.coalesce(F.array_sort(F.transform("product_ids", lambda x: F.lower(x))), F.expr(_NONE))
    return results.withColumn("expected", expected).withColumn("actual", actual).withColumn(
        "passed", F.col("expected").eqNullSafe(F.col("actual"))
    )


def golden_check_by_store(checked: DataFrame, store_col: str) -> DataFrame:
    return checked.groupBy(store_col).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    )
