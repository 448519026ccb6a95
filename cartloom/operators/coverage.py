"""Store coverage of URL logs and of the store catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.text import js_trim
from cartloom.sources.registry import dim_store_by_id


def has_json_items(c: Column) -> Column:
    """True for the text of a non-empty JSON array."""
    v = F.try_parse_json(c)
    return F.coalesce(
        F.schema_of_variant(v).startswith("ARRAY") & F.try_variant_get(v, "$[0]", "variant").isNotNull(), F.lit(False)
    )


def store_row_stats(log: DataFrame, order_col: str) -> DataFrame:
    """Per store: first name, rows, rows with extracted ids, rows with matched product ids; rows without store are skipped."""
    store = F.nullif(js_trim(F.col("store_id")), F.lit(""))
    name = F.coalesce(F.nullif(js_trim(F.col("store_name")), F.lit("")), F.lit("Unknown"))
    return (
        log.select(
            store.alias("store_id"),
            name.alias("store_name"),
            (F.coalesce(js_trim(F.col("url_ids_csv")), F.lit("")) != "").alias("has_ids"),
            has_json_items(F.col("product_ids")).alias("has_products"),
            F.col(order_col).alias("o"),
        )
        .where(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(
            F.min_by("store_name", "o").alias("store_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if("has_ids").alias("rows_with_ids"),
            F.count_if("has_products").alias("rows_with_product_ids"),
        )
    )


def coverage_split(stats: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stores the registry knows by id or alias id, stores it lacks)."""
    known = dim_store_by_id(registry).select("store_id")
    return stats.join(known, "store_id", "left_semi"), stats.join(known, "store_id", "left_anti")


def with_coverage(stats: DataFrame, registry: DataFrame) -> DataFrame:
    known = dim_store_by_id(registry).select("store_id", F.lit(True).alias("known"))
    return stats.join(known, "store_id", "left").withColumn("covered", F.col("known").isNotNull()).drop("known")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, zero where there is nothing to share."""
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)), digits)


def coverage_totals(stats: DataFrame, registry: DataFrame) -> DataFrame:
    covered = F.col("covered")
    return (
        with_coverage(stats, registry)
        .agg(
            F.count(F.lit(1)).alias("stores"),
            F.count_if(covered).alias("covered_stores"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.when(covered, F.col("row_count"))), F.lit(0)).alias("covered_rows"),
            F.coalesce(F.sum("rows_with_ids"), F.lit(0)).alias("rows_with_ids"),
            F.coalesce(F.sum("rows_with_product_ids"), F.lit(0)).alias("rows_with_product_ids"),
        )
        .withColumn("store_percent", percent(F.col("covered_stores"), F.col("stores")))
        .withColumn("row_percent", percent(F.col("covered_rows"), F.col("total_rows")))
        .withColumn("id_percent", percent(F.col("rows_with_ids"), F.col("total_rows")))
        .withColumn("product_percent", percent(F.col("rows_with_product_ids"), F.col("total_rows")))
    )


def coverage_breakdown(stats: DataFrame, registry: DataFrame, top: int | None = None) -> DataFrame:
    """Per store with percentages, covered stores first and busiest first; ``top`` limits the report."""
    rows = (
        with_coverage(stats, registry)
        .withColumn("id_percent", percent(F.col("rows_with_ids"), F.col("row_count")))
        .withColumn("product_percent", percent(F.col("rows_with_product_ids"), F.col("row_count")))
        .orderBy(F.desc("covered"), F.desc("row_count"), "store_id")
    )
    return rows.limit(top) if top else rows


def catalog_coverage(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of the enabled catalog stores, and of all of them, that the registry knows."""
    known = dim_store_by_id(registry).select(F.col("store_id").alias("known_id"))
    joined = catalog.join(known, F.col("id").cast("string") == F.col("known_id"), "left")
    enabled, in_registry = F.col("product_search_enabled"), F.col("known_id").isNotNull()
    return (
        joined.agg(
            F.count(F.lit(1)).alias("catalog_stores"),
            F.count_if(enabled).alias("enabled_stores"),
            F.count_if(enabled & in_registry).alias("covered_enabled"),
            F.count_if(in_registry).alias("covered_all"),
        )
        .withColumn("enabled_percent", percent(F.col("covered_enabled"), F.col("enabled_stores")))
        .withColumn("total_percent", percent(F.col("covered_all"), F.col("catalog_stores"), 2))
    )


def registry_issues(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry ids that are not enabled in the catalog, with the kind of issue."""
    ids = dim_store_by_id(registry).select("store_id")
    entries = catalog.select(F.col("id").cast("string").alias("store_id"), "name", "product_search_enabled")
    joined = ids.join(entries, "store_id", "left").where(~F.coalesce("product_search_enabled", F.lit(False)))
    return joined.select(
        "store_id",
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.when(F.col("store_id").try_cast("double").isNull(), F.lit("not_numeric"))
        .when(F.col("name").isNull(), F.lit("unknown_to_catalog"))
        .otherwise(F.lit("not_enabled"))
        .alias("issue"),
    )


def url_log_gaps(log: DataFrame, since: str | None = None, no_ids: bool = False, no_products: bool = False) -> DataFrame:
    """Distinct log rows, optionally only after a date, without extracted ids, or without product ids."""
    rows = log
    if since:
        rows = rows.where(F.col("insert_date") > F.lit(since).cast("date"))
    if no_ids:
        rows = rows.where(F.coalesce(F.trim("url_ids_csv"), F.lit("")) == "")
    if no_products:
        v = F.try_parse_json("product_ids")
        empty = F.schema_of_variant(v).startswith("ARRAY") & ~has_json_items(F.col("product_ids"))
        rows = rows.where(F.col("product_ids").isNull() | F.coalesce(empty, F.lit(False)))
    return rows.select("url", "store_id", "store_name", "url_ids_csv", "product_ids").distinct()
