"""Registered queries for the session reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators import sessions as s
from cartloom.plans.adapters import session_views, view
from cartloom.plans.url_queries import Query, all_urls, joined
from cartloom.sources.registry import builtin_registry


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views, items = session_views(spark, sf_dir, "session_views", "session_cart_items")
    return views, items


def _report(fn: Callable[..., DataFrame], **rounded: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(*_inputs(spark, sf_dir))
        return out.withColumns({c: F.round(c, d) for c, d in rounded.items()})

    return query


def unique_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.unique_products(_inputs(spark, sf_dir)[0]).drop("first_pos")


def unique_product_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.unique_product_values(_inputs(spark, sf_dir)[0])


def _of_items(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_inputs(spark, sf_dir)[1])


def predict_match_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.predict_match_strategy(*_inputs(spark, sf_dir)).withColumn("alternatives", joined("alternatives"))


def strategy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.strategy_distribution(s.predict_match_strategy(*_inputs(spark, sf_dir)))
    return out.withColumn("percent", F.round("percent", 6))


def session_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = s.session_quality_score(*_inputs(spark, sf_dir)).withColumn("score", F.col("score").cast("long"))
    return scored.withColumns({c: F.round(c, 6) for c in ("id_extraction", "id_overlap", "match_confidence")})


def query_param_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = all_urls(spark, sf_dir).select("url").unionByName(view(spark, sf_dir, "url_log").select("url"))
    return s.query_param_frequency(urls)


def image_id_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.image_id_patterns(s.final_cart_lines(_inputs(spark, sf_dir)[1]))


def session_registry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status against a registry with one store per supplier, whose ids meet the store ids of the sessions."""
    return s.session_registry_status(*_inputs(spark, sf_dir), view(spark, sf_dir, "store_registry"))


def new_golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = view(spark, sf_dir, "known_golden")
    out = s.new_golden_candidates(*_inputs(spark, sf_dir), golden)
    return out.withColumn("shape_ids", joined("shape_ids"))


QUERIES: dict[str, Query] = {
    "session_store_metadata": _report(s.session_store_metadata),
    "unique_products": unique_products,
    "unique_product_values": unique_product_values,
    "cart_evolution": _of_items(s.cart_evolution),
    "final_cart": _of_items(s.final_cart),
    "session_data_quality": _report(s.session_data_quality),
    "data_quality_issues": _report(lambda v, i: s.data_quality_issues(s.session_data_quality(v, i))),
    "match_potential": _report(s.match_potential, match_rate=6),
    "predict_match_strategy": predict_match_strategy,
    "strategy_distribution": strategy_distribution,
    "id_extraction_rates": _report(s.id_extraction_rates),
    "id_overlap": _report(s.id_overlap),
    "session_quality_score": session_quality_score,
    "strategy_availability": _report(s.strategy_availability, avg_skus=6),
    "title_similarity_buckets": _report(s.title_similarity_buckets),
    "query_param_frequency": query_param_frequency,
    "image_id_patterns": image_id_patterns,
    "title_prefix_suffix_mining": _report(s.title_prefix_suffix_mining),
    "price_unit_check": _report(s.price_unit_check, avg_cart_price=4, avg_product_price=4),
    "unmatched_colors": _report(s.unmatched_colors),
    "extracted_id_reliability": _report(s.extracted_id_reliability, reliability=6),
    "improvement_suggestions": _report(s.improvement_suggestions),
    "session_registry_status": session_registry_status,
    "new_golden_candidates": new_golden_candidates,
}
