"""Registered queries over URLs: validation, normalisation, product ids, mining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.text import image_sku_ids
from cartloom.functions.urls import is_public_host, with_url_components, with_url_parts
from cartloom.operators import product_ids as ids
from cartloom.operators import url_mining as mining
from cartloom.plans.adapters import table, view
from cartloom.sources.files import catalog_from_table
from cartloom.sources.public_suffixes import suffix_rules
from cartloom.sources.registry import builtin_registry, store_lookup

Query = Callable[[SparkSession, str], DataFrame]


def joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled page URLs and product URLs in one table."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("url_id"), "url", F.lit(None).cast("string").alias("store_id")
    )
    products = view(spark, sf_dir, "product_urls").select(
        F.concat(F.lit("part-"), F.col("page_id").cast("string")).alias("url_id"), "url", "store_id"
    )
    return pages.unionByName(products)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_url_components(all_urls(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.with_product_ids(_components(spark, sf_dir), builtin_registry(spark)).where(F.col("error").isNull())


def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_url_parts(all_urls(spark, sf_dir)).select(
        "url_id", F.col("u_error").isNull().alias("is_valid"), F.col("u_error").alias("error"), F.col("u_message").alias("message")
    )


def url_public_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = with_url_parts(all_urls(spark, sf_dir)).where(F.col("u_error").isNull())
    return parts.where(is_public_host(F.col("u_host"))).select("url_id", F.col("u_host").alias("host"))


def _select(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _components(spark, sf_dir).where(F.col("error").isNull()).select("url_id", *columns)

    return query


def url_domain_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of all URLs by a suffix list held as a table."""
    hosts = view(spark, sf_dir, "suffix_hosts").select(F.concat_ws("-", F.lit("host"), "c_custkey", "form").alias("url_id"), "url", F.lit(None).cast("string").alias("store_id"))
    rules = suffix_rules(view(spark, sf_dir, "suffix_list"))
    parts = with_url_components(all_urls(spark, sf_dir).unionByName(hosts), suffixes=rules)
    return parts.where(F.col("error").isNull()).select("url_id", "hostname", "domain")


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key, the first by id."""
    keyed = _components(spark, sf_dir).where(F.col("error").isNull()).select("key", "url_id", "href")
    return keyed.groupBy("key").agg(F.min_by("href", "url_id").alias("href"), F.min("url_id").alias("url_id"), F.count(F.lit(1)).alias("copies"))


def _id_column(column: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _found(spark, sf_dir)
        return found.select("url_id", joined(F.array_sort(column)).alias("ids"))

    return query


def extract_generic_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).where(F.size("store_path_ids") == 0)
    return found.select("url_id", joined(F.array_sort("path_ids")).alias("ids"))


def extract_generic_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _components(spark, sf_dir).where(F.col("error").isNull())
    return urls.select("url_id", joined(F.array_sort(ids.generic_query_ids(F.lower("search")))).alias("ids"))


def extract_store_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = store_lookup(_components(spark, sf_dir).where(F.col("error").isNull()), builtin_registry(spark))
    return urls.select(
        "url_id", joined(F.array_sort(ids.store_pattern_ids(F.lower("search"), F.col("query_patterns")))).alias("ids")
    )


def transform_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path ids of the stores that rewrite them, before and after."""
    urls = store_lookup(_components(spark, sf_dir).where(F.col("error").isNull()), builtin_registry(spark))
    raw = urls.where(F.col("rewrite_find").isNotNull()).withColumn(
        "raw_ids", ids.store_pattern_ids(F.lower("pathname"), F.col("path_patterns"))
    )
    return raw.select(
        "url_id",
        joined(F.array_sort("raw_ids")).alias("raw_ids"),
        joined(F.array_sort(ids.rewrite_ids(F.col("raw_ids"), F.col("rewrite_find"), F.col("rewrite_to")))).alias("ids"),
    )


def finalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("url_id", joined("found_ids").alias("ids"), F.col("id_error").isNull().alias("is_valid"))


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.url_analysis(all_urls(spark, sf_dir), builtin_registry(spark))


def url_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).select(
        "url_id", "url", "store_id", joined("product_ids").alias("product_ids"), F.col("count").cast("long").alias("id_count"), "success", "error", "message"
    )


def url_analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.result_summary(_analysis(spark, sf_dir))


def image_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "cart_lines")
    return lines.select("session_id", "item_pos", joined(image_sku_ids(F.col("image_url"))).alias("ids"))


def golden_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of every part, passed and failed per store."""
    golden = view(spark, sf_dir, "golden_urls")
    checked = ids.golden_url_check(golden, builtin_registry(spark))
    return ids.golden_check_by_store(checked, "store_name")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.analyze_url_shape(all_urls(spark, sf_dir))


def mining_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mining_url_normalize(all_urls(spark, sf_dir)).select("url_id", "m_url")


def non_product_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = all_urls(spark, sf_dir).where(F.col("url").isNotNull()).withColumn("expected", F.lit("example.com"))
    return mining.non_product_filter(urls, "url", "expected").select("url_id", "reject_reason", "reject_explanation")


def mining_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mining_dedup(all_urls(spark, sf_dir).where(F.col("url").isNotNull()), "url_id").select("url_id", "m_url")


def analyze_url_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select(
        "url_id", joined("shape_ids").alias("shape_ids"), "id_location", "id_format", "id_confidence",
        F.col("id_from_end").cast("long").alias("id_from_end"), "id_param", "id_description",
    )


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.url_pattern_coverage(_shapes(spark, sf_dir), "url_id")


def url_pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select(
        "domain", "id_location", F.col("id_from_end").cast("long").alias("id_from_end"), "id_param", "id_format", "url_count",
        F.round("coverage", 6).alias("coverage"), "confidence", joined("example_urls").alias("example_urls"), "covered_by_generic",
    )


def urls_without_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.urls_without_pattern(_shapes(spark, sf_dir)).select("url_id", "url")


def suggest_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.suggest_patterns(_coverage(spark, sf_dir)).select("domain", "id_location", "id_param", "id_format", "regex")


def evaluate_candidate_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mining.evaluate_candidate_patterns(_shapes(spark, sf_dir), mining.suggest_patterns(_coverage(spark, sf_dir)))
    return rated.select("domain", "id_location", "regex", "urls", "matched", "agreed", F.round("hit_rate", 6).alias("hit_rate"))


def validate_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = mining.validate_store_rows(
        view(spark, sf_dir, "store_registry").select("pos", "id", "domain"), catalog_from_table(view(spark, sf_dir, "store_catalog"))
    )
    return checked.select("pos", "id", "domain", "id_error", "domain_error", "catalog_name")


QUERIES: dict[str, Query] = {
    "url_validate": url_validate,
    "url_public_filter": url_public_filter,
    "url_normalize": _select("href"),
    "url_strip_tracking": _select("search"),
    "url_domain": _select("hostname", "domain"),
    "url_domain_by_rules": url_domain_by_rules,
    "url_key": _select("key"),
    "url_components": _select("href", "encoded_href", "hostname", "pathname", "search", "domain", "key", "original"),
    "url_dedup": url_dedup,
    "extract_store_path_ids": _id_column("store_path_ids"),
    "extract_generic_path_ids": extract_generic_path_ids,
    "extract_store_query_ids": extract_store_query_ids,
    "extract_generic_query_ids": extract_generic_query_ids,
    "transform_ids": transform_ids,
    "finalize_ids": finalize_ids,
    "url_analysis": url_analysis,
    "url_analysis_summary": url_analysis_summary,
    "image_sku_ids": image_sku,
    "golden_url_check": golden_url_check,
    "mining_url_normalize": mining_url_normalize,
    "non_product_filter": non_product_filter,
    "mining_dedup": mining_dedup,
    "analyze_url_shape": analyze_url_shape,
    "url_pattern_coverage": url_pattern_coverage,
    "urls_without_pattern": urls_without_pattern,
    "suggest_patterns": suggest_patterns,
    "evaluate_candidate_patterns": evaluate_candidate_patterns,
    "validate_store_rows": validate_store_rows,
}
