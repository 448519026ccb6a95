"""Registered queries that match cart lines to viewed products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.text import character_pairs, comparable_title, dice, levenshtein_similarity, with_title_similarity, words
from cartloom.operators import enrichment, matching
from cartloom.plans.adapters import session_views
from cartloom.plans.url_queries import Query, joined


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    carts, products = session_views(spark, sf_dir, "cart_lines", "viewed_products")
    return carts, products


def _strategy(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matching.match_strategy(*_inputs(spark, sf_dir), method)
        return found.withColumn("variant_pos", F.col("variant_pos").cast("long"))

    return query


def _signal_text(c: str) -> Column:
    return joined(F.transform(c, lambda s: F.concat_ws(":", s["method"], s["confidence"], s["exact"].cast("string"))))


def _title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a cart title and a product title of the same order line."""
    carts, products = _inputs(spark, sf_dir)
    return (
        carts.select("session_id", F.col("item_pos").alias("pos"), comparable_title(F.col("title")).alias("a"))
        .join(products.select("session_id", F.col("product_pos").alias("pos"), comparable_title(F.col("title")).alias("b")), ["session_id", "pos"])
        .select("a", "b")
        .distinct()
    )


def _title_function(name: str, fn) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _title_pairs(spark, sf_dir).select("a", "b", F.round(fn(F.col("a"), F.col("b")), 6).alias(name))

    return query


def comparable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    carts, _ = _inputs(spark, sf_dir)
    return carts.select("title", comparable_title(F.col("title")).alias("normalized")).distinct()


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_title_similarity(_title_pairs(spark, sf_dir), "a", "b").select("a", "b", F.round("score", 6).alias("score"))


def signal_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price agreement of every matched line with its primary product."""
    found = enrichment.primary_matches(*_inputs(spark, sf_dir))
    return found.where(F.col("price_exact").isNotNull()).select("session_id", "item_pos", "price_exact")


def match_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrichment.primary_matches(*_inputs(spark, sf_dir))
    return found.select("session_id", "item_pos", _signal_text("signals").alias("signals"))


def match_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    carts, products = _inputs(spark, sf_dir)
    found = matching.match_signals(matching.match_candidates(carts, products))
    return found.select("session_id", "item_pos", "method", "confidence", "product_pos", F.col("variant_pos").cast("long").alias("variant_pos"))


def _enriched(spark: SparkSession, sf_dir: str, min_confidence: str = "low") -> DataFrame:
    return enrichment.enrich_cart(*_inputs(spark, sf_dir), min_confidence=min_confidence)


def match_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per outcome at each minimum confidence."""
    enriched = enrichment.enrich_cart(*_inputs(spark, sf_dir), min_confidence=("high", "medium", "low"))
    counted = enriched.groupBy("was_viewed", "match_confidence", "match_method", "min_confidence").agg(F.count(F.lit(1)).alias("items"))
    return counted.select("was_viewed", "match_confidence", "match_method", "items", "min_confidence")


def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select(
        "session_id", "item_pos", "title", "url", "image_url", "price", "currency", "brand", "description", "category", "rating"
    )


def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["title", "url", "image_url", "price", "brand", "description", "category", "rating", "ids"]
    return _enriched(spark, sf_dir).select("session_id", "item_pos", *[F.col(f"sources.{f}").alias(f"from_{f}") for f in fields])


def merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("session_id", "item_pos", *[joined(k).alias(k) for k in enrichment.ID_KINDS])


def matched_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).where(F.col("matched_variant").isNotNull()).select("session_id", "item_pos", "matched_variant.*")


def enrich_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _enriched(spark, sf_dir, enrichment.DEFAULT_MIN_CONFIDENCE)
    return e.select(
        "session_id", "item_pos", "title", "url", "store_id", "price", "quantity", "line_total", "brand", "currency", "was_viewed",
        "match_confidence", "match_method", "product_pos", _signal_text("matched_signals").alias("matched_signals"),
        joined("skus").alias("skus"), F.col("matched_variant.sku").alias("variant_sku"),
    )


def enrichment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = enrichment.enrichment_summary(_enriched(spark, sf_dir))
    return s.withColumn("match_rate", F.round("match_rate", 6))


def enrichment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrichment_totals(_enriched(spark, sf_dir))


def store_mismatch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.store_mismatch_guard(*_inputs(spark, sf_dir))


def unmatched_cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.unmatched_cart_lines(_enriched(spark, sf_dir)).select("session_id", "item_pos", "title")


QUERIES: dict[str, Query] = {
    **{f"match_{m}": _strategy(m) for m in matching.METHODS},
    "signal_price": signal_price,
    "title_normalize": comparable_titles,
    "token_dice": _title_function("token_dice", lambda a, b: dice(words(a), words(b))),
    "bigram_dice": _title_function("bigram_dice", lambda a, b: dice(character_pairs(a), character_pairs(b))),
    "levenshtein_similarity": _title_function("levenshtein_similarity", levenshtein_similarity),
    "title_similarity": title_similarity,
    "match_signals": match_signals,
    "match_primary": match_primary,
    "match_threshold": match_threshold,
    "merge_fields": merge_fields,
    "field_provenance": field_provenance,
    "merge_ids": merge_ids,
    "matched_variant": matched_variant,
    "enrich_cart": enrich_cart,
    "enrichment_summary": enrichment_summary,
    "enrichment_totals": enrichment_totals,
    "store_mismatch_guard": store_mismatch_guard,
    "unmatched_cart_lines": unmatched_cart_lines,
}
