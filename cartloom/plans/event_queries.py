"""Registered queries over raw events: product views and carts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.prices import price_currency, price_to_cents
from cartloom.operators import carts
from cartloom.operators import product_views as views
from cartloom.operators.product_ids import result_summary
from cartloom.plans.adapters import view
from cartloom.plans.url_queries import Query, joined
from cartloom.session import scratch_dir
from cartloom.sources.events import CART_KINDS, event_violations, parse_cart_events, parse_product_views, read_cart_events, read_product_views
from cartloom.sources.registry import builtin_registry


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_product_views(view(spark, sf_dir, "raw_views")).drop("session_id", "product_pos")


def _carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_cart_events(view(spark, sf_dir, "raw_carts")).drop("session_id", "created_ts")


def _as_text(v: str) -> Column:
    return joined(F.transform(v, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in ("sku", "url", "image_url", "price", "currency", "color")])))


def read_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw view events through JSON-lines files in the shared folder."""
    path = scratch_dir(spark, "views")
    view(spark, sf_dir, "raw_views").select(F.col("raw").alias("value")).write.text(path)
    events = read_product_views(spark, path)
    return events.select(
        views.coerce_store_id(F.col("e.store_id")).alias("store_id"), views.first_text(F.col("e.name")).alias("name"),
        F.coalesce(F.size("e.sku"), F.lit(-1)).cast("long").alias("skus"),
    ).groupBy("store_id", "name", "skus").agg(F.count(F.lit(1)).alias("events"))


def read_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "carts")
    view(spark, sf_dir, "raw_carts").select(F.col("raw").alias("value")).write.text(path)
    events = read_cart_events(spark, path)
    return events.select(
        views.coerce_store_id(F.col("e.store_id")).alias("store_id"), F.size("e.product_list").cast("long").alias("listed"), F.col("e.created_ts").alias("created_ts")
    ).groupBy("store_id", "listed", "created_ts").agg(F.count(F.lit(1)).alias("events"))


def scalar_or_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).select(
        "event_id", views.first_text(F.col("e.name")).alias("first_name"), joined(views.all_texts(F.col("e.url"))).alias("urls"),
        joined(views.all_texts(F.col("e.color"))).alias("colors"),
    )


def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).select("event_id", views.first_number(F.col("e.rating")).alias("rating"))


def price_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price of the price list and of the offers in cents."""
    e = _views(spark, sf_dir)
    prices = e.select("event_id", F.lit("price").alias("place"), F.posexplode("e.price").alias("pos", "p")).unionByName(
        e.select("event_id", F.lit("offer").alias("place"), F.posexplode("e.offers.price").alias("pos", "p"))
    )
    return prices.select("event_id", "place", F.col("pos").cast("long").alias("pos"), price_to_cents(F.col("p")).alias("cents"), price_currency(F.col("p")).alias("currency"))


def coerce_store_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).select("event_id", views.coerce_store_id(F.col("e.store_id")).alias("store_id"))


def collect_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).select("event_id", *[joined(c).alias(n) for n, c in views.identifiers().items()])


def _variants(build) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = build(views.prepare_views(_views(spark, sf_dir)))
        return built.where(F.size("variants") > 0).select("event_id", _as_text("variants").alias("variants"))

    return query


def primary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _views(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in views.primary_fields().items()], views.primary_price().alias("pp"))
    return priced.select("*", F.col("pp.price").alias("price"), F.col("pp.currency").alias("currency")).drop("pp")


def _products(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return views.normalize_product_views(_views(spark, sf_dir), builtin_registry(spark), **options)


_IDS = ["product_ids", "extracted_ids", "skus", "gtins", "mpns"]


def normalize_product_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _products(spark, sf_dir)
    return p.select(
        "event_id", "title", "url", "canonical_url", "image_url", "store_id", "store_name", "brand", "description", "category", "color",
        "rating", "price", "currency", F.col("variant_count").cast("long").alias("variant_count"), "has_variants",
        *[joined(i).alias(i) for i in _IDS], joined(F.transform("variants", lambda v: v["sku"])).alias("variant_skus"),
    )


def normalize_without_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _products(spark, sf_dir, extract_ids=False, include_metadata=False)
    return p.select("event_id", "title", "url", "brand", "price", joined("skus").alias("skus"), joined("extracted_ids").alias("extracted_ids"), F.col("variant_count").cast("long").alias("variant_count"))


def product_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.product_variants(_products(spark, sf_dir))
    return v.select(
        "event_id", F.col("variant_count").cast("long").alias("variant_count"), "has_variants", F.col("variant_pos").cast("long").alias("variant_pos"),
        "sku", "url", "image_url", "price", "currency", "color", joined("extracted_ids").alias("extracted_ids"),
    )


def product_view_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse_product_views(view(spark, sf_dir, "mixed_views"))
    products = views.normalize_product_views(events, builtin_registry(spark), extract_ids=False)
    return result_summary(carts.batch_results(events, products), "products")


def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = event_violations(view(spark, sf_dir, "raw_views"))
    return checked.select("event_id", (F.size("violations") == 0).alias("is_valid"), joined(F.array_sort("violations")).alias("reason"))


def validate_cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = event_violations(view(spark, sf_dir, "mixed_carts"), CART_KINDS)
    return checked.select("event_id", (F.size("violations") == 0).alias("is_valid"), joined(F.array_sort("violations")).alias("reason"))


def cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carts.cart_lines(_carts(spark, sf_dir)).select("event_id", F.col("item_pos").cast("long").alias("item_pos"), "store_id", "name", "url", "item_price")


def cart_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = carts.cart_line_filter(carts.cart_lines(_carts(spark, sf_dir)))
    return lines.select("event_id", F.col("item_pos").cast("long").alias("item_pos"), "name", "url")


def _cart_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carts.normalize_cart_events(_carts(spark, sf_dir), builtin_registry(spark))


def normalize_cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cart_products(spark, sf_dir).select(
        "event_id", F.col("item_pos").cast("long").alias("item_pos"), "title", "url", "image_url", "store_id", "price", "quantity", "line_total",
        joined("product_ids").alias("product_ids"), joined("extracted_ids").alias("extracted_ids"),
    )


def cart_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line per URL or id list within a session."""
    return carts.cart_dedup(view(spark, sf_dir, "cart_lines"), "session_id").select("session_id", "item_pos", "url", "quantity")


def cart_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse_cart_events(view(spark, sf_dir, "mixed_carts"))
    products = carts.normalize_cart_events(events, builtin_registry(spark), extract_ids=False)
    return result_summary(carts.batch_results(events, products), "products")


QUERIES: dict[str, Query] = {
    "read_product_views": read_views,
    "read_cart_events": read_carts,
    "scalar_or_list_text": scalar_or_list_text,
    "first_number": first_number,
    "price_to_cents": price_cents,
    "coerce_store_id": coerce_store_id,
    "collect_identifiers": collect_identifiers,
    "variants_from_url_map": _variants(lambda p: p.withColumn("variants", views.variants_from_url_map())),
    "variants_from_offers": _variants(lambda p: p.withColumn("variants", F.col("offer_variants"))),
    "variants_from_offer_list": _variants(lambda p: p.withColumn("variants", F.col("listed_variants"))),
    "variants_from_parallel_arrays": _variants(lambda p: p.withColumn("variants", views.variants_from_parallel_arrays())),
    "choose_variants": _variants(views.with_chosen_variants),
    "primary_fields": primary_fields,
    "normalize_product_views": normalize_product_views,
    "normalize_views_without_metadata": normalize_without_metadata,
    "product_variants": product_variants,
    "product_view_batch_summary": product_view_batch_summary,
    "validate_events": validate_events,
    "validate_cart_events": validate_cart_events,
    "cart_lines": cart_lines,
    "cart_line_filter": cart_line_filter,
    "normalize_cart_events": normalize_cart_events,
    "cart_dedup": cart_dedup,
    "cart_batch_summary": cart_batch_summary,
}
