"""Cart lines merged with the viewed product they were matched to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.prices import prices_close
from cartloom.operators.matching import (
    CONFIDENCE_RANK,
    DEFAULT_MIN_CONFIDENCE,
    DEFAULT_TITLE_THRESHOLD,
    METHODS,
    match_candidates,
    match_signals,
)

ID_KINDS = ["product_ids", "extracted_ids", "skus", "gtins", "mpns"]
_NO_STRINGS = "cast(array() as array<string>)"


def _first_store(df: DataFrame, pos: str, out: str) -> DataFrame:
    return df.groupBy("session_id").agg(F.min_by("store_id", pos).alias(out))


def store_mismatch_guard(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Sessions whose first cart line and first product name different stores, with the reason."""
    both = _first_store(cart, "item_pos", "cart_store_id").join(
        _first_store(products, "product_pos", "product_store_id"), "session_id"
    )
    named = (F.col("cart_store_id") != "") & (F.col("product_store_id") != "")
    # fixed value: the wording of the rejection
    return both.where(named & (F.col("cart_store_id") != F.col("product_store_id"))).withColumn(
        "message",
        F.concat(
            F.lit('Store ID mismatch: cart storeId "'),
            "cart_store_id",
            F.lit('" does not match product storeId "'),
            "product_store_id",
            F.lit('"'),
        ),
    )


def price_signal(price: Column, product_price: Column, variants: Column) -> Column:
    """Exactness of the price agreement with the product or its first agreeing variant; null when none agrees."""
    close = F.filter(variants, lambda v: prices_close(price, v["price"]))
    return (
        F.when(prices_close(price, product_price), price == product_price)
        .when(F.size(F.coalesce(close, F.slice(variants, 1, 0))) > 0, price == F.get(close, F.lit(0))["price"])
    )


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _with_product(cart: DataFrame, products: DataFrame, threshold: float, kept: DataFrame | None = None) -> DataFrame:
    """Cart lines, or the ``kept`` ones of them, with their primary match and the whole matched product as ``p``."""
    matches = match_signals(match_candidates(cart, products, threshold))
    lines = (cart if kept is None else kept).join(matches, ["session_id", "item_pos"], "left")
    payload = products.select(
        "session_id", "product_pos", F.struct(*[c for c in products.columns if c not in ("session_id", "product_pos")]).alias("p")
    )
    return lines.join(payload, ["session_id", "product_pos"], "left")


def primary_matches(cart: DataFrame, products: DataFrame, threshold: float = DEFAULT_TITLE_THRESHOLD) -> DataFrame:
    """One row per matched cart line with its primary match and all signals, price agreement last."""
    joined = _with_product(cart, products, threshold).where(F.col("method").isNotNull())
    return joined.withColumn("price_exact", price_signal(F.col("price"), F.col("p.price"), F.col("p.variants"))).select(
        "session_id",
        "item_pos",
        "product_pos",
        "variant_pos",
        "method",
        "confidence",
        "price_exact",
        _with_price_signal(F.col("signals"), F.col("price_exact")).alias("signals"),
    )


def _with_price_signal(signals: Column, price_exact: Column) -> Column:
    return F.when(
        price_exact.isNotNull(),
        F.array_append(
            signals,
            F.struct(F.lit("price").alias("method"), F.lit("low").alias("confidence"), price_exact.alias("exact")),
        ),
    ).otherwise(signals)


def enrich_cart(
    cart: DataFrame,
    products: DataFrame,
    min_confidence: str | Sequence[str] = DEFAULT_MIN_CONFIDENCE,
    title_threshold: float = DEFAULT_TITLE_THRESHOLD,
    guard: bool = True,
) -> DataFrame:
    """Every cart line with merged fields, where each field came from, and how it was matched.

    ``guard`` leaves out the sessions that ``store_mismatch_guard`` reports. Of several minimum confidences each gives its own row of every
    line, told by ``min_confidence``; the lines are matched once.
    """
    rank = F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv])
    levels = [] if isinstance(min_confidence, str) else ["min_confidence"]
    # the guard leaves out whole sessions, so it need not come before each of the reads that matching does
    kept = cart.join(store_mismatch_guard(cart, products).select("session_id"), "session_id", "left_anti") if guard else cart
    joined = _with_product(cart, products, title_threshold, kept)
    least = F.lit(CONFIDENCE_RANK[min_confidence]) if not levels else rank[F.col("min_confidence")]
    if levels:
        joined = joined.withColumn("min_confidence", F.explode(F.array(*[F.lit(c) for c in min_confidence])))
    viewed = F.coalesce(rank[F.col("confidence")] >= least, F.lit(False))
    accepted = joined.withColumn("was_viewed", viewed).withColumn("p", F.when(F.col("was_viewed"), F.col("p")))
    variant = F.when(F.col("was_viewed") & F.col("variant_pos").isNotNull(), F.get("p.variants", "variant_pos"))
    lines = accepted.withColumn("v", variant).withColumn(
        "price_exact", price_signal(F.col("price"), F.col("p.price"), F.col("p.variants"))
    )

    def from_cart(name: str) -> Column:
        return F.coalesce(F.col(name), F.col(f"p.{name}"))

    def origin(name: str, fallback: Column) -> Column:
        return F.when(_given(F.col(name)), F.lit("cart")).when(fallback, F.lit("product")).alias(name)

    def merged(name: str) -> Column:
        both = F.array_union(F.coalesce(F.col(name), F.expr(_NO_STRINGS)), F.coalesce(F.col(f"p.{name}"), F.expr(_NO_STRINGS)))
        return F.when(F.col("was_viewed"), both).otherwise(F.col(name)).alias(name)

    def of_product(name: str) -> Column:
        return F.when(_given(F.col(f"p.{name}").cast("string")), F.lit("product")).alias(name)

    sources = F.struct(
        origin("title", _given(F.col("p.title"))),
        origin("url", _given(F.col("p.url"))),
        origin("image_url", _given(F.col("v.image_url")) | _given(F.col("p.image_url"))),
        F.when(F.col("price").isNotNull(), F.lit("cart")).alias("price"),
        of_product("brand"),
        of_product("description"),
        of_product("category"),
        of_product("rating"),
        F.when(F.col("was_viewed"), F.lit("merged")).otherwise(F.lit("cart")).alias("ids"),
    )
    empty_signals = F.slice(F.array(F.struct(F.lit("").alias("method"), F.lit("").alias("confidence"), F.lit(False).alias("exact"))), 1, 0)
    return lines.select(
        "session_id",
        "item_pos",
        *levels,
        from_cart("title").alias("title"),
        from_cart("url").alias("url"),
        F.coalesce("image_url", "v.image_url", "p.image_url").alias("image_url"),
        "store_id",
        "price",
        F.coalesce("p.currency", "v.currency").alias("currency"),
        F.col("p.brand").alias("brand"),
        F.col("p.description").alias("description"),
        F.col("p.category").alias("category"),
        F.col("p.rating").alias("rating"),
        "quantity",
        "line_total",
        *[merged(k) for k in ID_KINDS],
        F.lit(True).alias("in_cart"),
        "was_viewed",
        F.when(F.col("was_viewed"), F.col("confidence")).otherwise(F.lit("none")).alias("match_confidence"),
        F.when(F.col("was_viewed"), F.col("method")).alias("match_method"),
        F.when(F.col("was_viewed"), F.col("product_pos")).alias("product_pos"),
        F.when(F.col("was_viewed"), _with_price_signal(F.col("signals"), F.col("price_exact"))).otherwise(empty_signals).alias("matched_signals"),
        sources.alias("sources"),
        F.when(
            F.col("v").isNotNull(),
            F.struct(*[F.col(f"v.{f}").alias(f) for f in ("sku", "url", "image_url", "price", "currency", "color")]),
        ).alias("matched_variant"),
        F.current_timestamp().alias("enriched_at"),
    )


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    """Counts per session: totals, match rate, by confidence and by method."""
    counts = [
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("was_viewed").alias("matched_items"),
        F.count_if(~F.col("was_viewed")).alias("unmatched_items"),
        *[F.count_if(F.col("match_confidence") == c).alias(f"confidence_{c}") for c in CONFIDENCE_RANK],
        *[F.count_if(F.col("match_method") == m).alias(f"method_{m}") for m in [*METHODS, "price"]],
    ]
    summed = enriched.groupBy("session_id").agg(*counts)
    return summed.withColumn("match_rate", F.col("matched_items") * 100.0 / F.col("total_items"))


def enrichment_totals(enriched: DataFrame) -> DataFrame:
    """Counts over all sessions in long form, one row per confidence and one per method."""
    return (
        enriched.groupingSets([["match_confidence"], ["match_method"]], "match_confidence", "match_method")
        .agg(F.count(F.lit(1)).alias("items"), F.grouping("match_confidence").cast("int").alias("no_confidence"))
        .select(
            F.when(F.col("no_confidence") == 0, F.lit("confidence")).otherwise(F.lit("method")).alias("dimension"),
            F.when(F.col("no_confidence") == 0, F.col("match_confidence"))
            .otherwise(F.coalesce("match_method", F.lit("none")))
            .alias("value"),
            "items",
        )
    )


def unmatched_cart_lines(enriched: DataFrame) -> DataFrame:
    return enriched.where(~F.col("was_viewed"))
