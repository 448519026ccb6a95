"""Cart line to viewed product matching: eight strategies as one key join.

Every strategy that compares for equality becomes rows of (session, kind of key, key). Products contribute one row per
key with the first product that carries it, so a key that many products share costs one row on that side and the join
never multiplies. Fuzzy titles are scored once per distinct title and enter the same join. All shuffles are keyed by
session plus key (never by session alone), so one very large session spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.text import (
    comparable,
    comparable_title,
    comparable_url,
    image_sku_ids,
    with_title_parts,
    with_title_similarity,
)
from cartloom.operators.title_pairs import LEAST_KEYED, SMALL_SESSION_TITLES, all_title_pairs, busy_sessions, similarity_keys, title_elements, title_pairs

# Strategies in evaluation order with their confidence and whether they compare exactly.
STRATEGIES = [
    ("sku", "high", True),
    ("variant_sku", "high", True),
    ("image_sku", "high", True),
    ("extracted_id_sku", "high", True),
    ("url", "medium", True),
    ("extracted_id", "medium", True),
    ("title_color", "medium", True),
    ("title", "low", False),
]
CONFIDENCE_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}
METHODS = [s[0] for s in STRATEGIES]
DEFAULT_MIN_CONFIDENCE = "high"
DEFAULT_TITLE_THRESHOLD = 0.8

_SEP = "\x01"


def _exploded(df: DataFrame, keep: list[str], groups: Column, tags: list[str]) -> DataFrame:
    """One row per key: first the key groups of a row, then the keys of a group."""
    return (
        df.select(*keep, F.explode(groups).alias("g"))
        .select(*keep, *[F.col(f"g.{t}").alias(t) for t in tags], F.explode("g.keys").alias("key"))
        .where(F.col("key").isNotNull())
    )


def cart_keys(cart: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Rows ``session_id, item_pos, strategy, kind, key`` of everything a cart line can be matched by."""
    lines = with_title_parts(cart).select(
        "session_id",
        "item_pos",
        "skus",
        "extracted_ids",
        image_sku_ids(F.col("image_url")).alias("image_skus"),
        F.array(comparable_url(F.col("url"))).alias("urls"),
        F.array(F.concat(comparable(F.col("title_base")), F.lit(_SEP), comparable(F.col("title_color")))).alias("title_colors"),
        F.array(F.when(F.col("title") != "", comparable_title(F.col("title")))).alias("titles"),
    )
    wanted = [
        ("sku", "sku", "skus"),
        ("variant_sku", "variant_sku", "skus"),
        ("image_sku", "sku", "image_skus"),
        ("extracted_id_sku", "sku", "extracted_ids"),
        ("extracted_id_sku", "variant_sku", "extracted_ids"),
        ("url", "url", "urls"),
        ("extracted_id", "extracted_id", "extracted_ids"),
        ("title_color", "title_color", "title_colors"),
        ("title", "title", "titles"),
    ]
    groups = F.array(
        *[
            F.struct(F.lit(METHODS.index(m)).alias("strategy"), F.lit(kind).alias("kind"), F.col(values).alias("keys"))
            for m, kind, values in wanted
            if methods is None or m in methods
        ]
    )
    return _exploded(lines, ["session_id", "item_pos"], groups, ["strategy", "kind"])


def product_keys(products: DataFrame) -> DataFrame:
    """Rows ``session_id, kind, key, hit``: the first product, product level before variant level, per key."""
    title = comparable(F.coalesce("title", F.lit("")))
    none = F.lit(None).cast("array<string>")
    # variants side by side with their product; product-level keys ride on the first variant only
    rows = products.select(
        "session_id",
        "product_pos",
        title.alias("title"),
        "url",
        "color",
        "skus",
        "extracted_ids",
        F.posexplode_outer("variants").alias("variant_pos", "v"),
    ).select(
        "session_id",
        "product_pos",
        "variant_pos",
        F.coalesce(F.col("variant_pos") == 0, F.lit(True)).alias("lead"),
        "skus",
        "extracted_ids",
        F.array(comparable_url(F.col("url"))).alias("urls"),
        F.array(F.when(F.col("color") != "", F.concat("title", F.lit(_SEP), comparable(F.col("color"))))).alias("colors"),
        F.array(F.col("v.sku")).alias("v_skus"),
        F.col("v.extracted_ids").alias("v_ids"),
        F.array(comparable_url(F.col("v.url"))).alias("v_urls"),
        F.array(F.when(F.col("v.color") != "", F.concat("title", F.lit(_SEP), comparable(F.col("v.color"))))).alias("v_colors"),
    )

    def group(kind: str, values: str, level: int) -> Column:
        keys = F.col(values) if level else F.when(F.col("lead"), F.col(values)).otherwise(none)
        return F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), keys.alias("keys"))

    groups = F.array(
        group("sku", "skus", 0),
        group("url", "urls", 0),
        group("extracted_id", "extracted_ids", 0),
        group("title_color", "colors", 0),
        group("variant_sku", "v_skus", 1),
        group("url", "v_urls", 1),
        group("extracted_id", "v_ids", 1),
        group("title_color", "v_colors", 1),
    )
    keyed = _exploded(rows, ["session_id", "product_pos", "variant_pos"], groups, ["level", "kind"])
    return keyed.groupBy("session_id", "kind", "key").agg(
        F.min(F.struct("product_pos", "level", F.when(F.col("level") == 1, F.col("variant_pos")).alias("variant_pos"))).alias("hit")
    )


def _best_titles(pairs: DataFrame) -> DataFrame:
    """Best product of each cart title among the pairs, the first product on ties: ``session_id, key, best``."""
    # a threshold is applied to the best pair only: a filter before the aggregate would score every pair twice
    scored = with_title_similarity(pairs, "c_title", "p_title").groupBy("session_id", F.col("c_title").alias("key"))
    return scored.agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("p_product_pos").alias("product_pos"))).alias("best"))


def title_hits(cart: DataFrame, products: DataFrame, threshold: float, small_session: int = SMALL_SESSION_TITLES) -> DataFrame:
    """Best product per (session, cart title) among titles at least ``threshold`` similar, as rows of the key table.

    Below the similarity that blocking keys can settle, the cart titles that are still open are compared with all titles of their session.
    """
    carts = cart.where(F.col("title") != "").select("session_id", comparable_title(F.col("title")).alias("title")).distinct()
    titles = (
        products.where(F.col("title") != "")
        .groupBy("session_id", comparable_title(F.col("title")).alias("title"))
        .agg(F.min("product_pos").alias("product_pos"))
    )
    keyed = max(threshold, LEAST_KEYED)
    best = _best_titles(title_pairs(carts, titles, similarity_keys(keyed), title_elements, small_session, busy_sessions(products, small_session))).where(F.col("best.s") <= -keyed)
    if threshold < keyed:
        open_ = carts.join(best.select("session_id", F.col("key").alias("title")), ["session_id", "title"], "left_anti")
        best = best.unionByName(_best_titles(all_title_pairs(open_, titles)).where(F.col("best.s") <= -threshold))
    return best.select(
        "session_id",
        F.lit("title").alias("kind"),
        "key",
        F.struct(
            F.col("best.product_pos").alias("product_pos"),
            F.lit(0).alias("level"),
            F.lit(None).cast("int").alias("variant_pos"),
        ).alias("hit"),
    )


def match_candidates(
    cart: DataFrame, products: DataFrame, threshold: float = DEFAULT_TITLE_THRESHOLD, methods: list[str] | None = None
) -> DataFrame:
    """First hit of every strategy per cart line: ``session_id, item_pos, hits`` with one field per strategy."""
    wanted = methods or METHODS
    lines = cart_keys(cart, wanted)
    keys = product_keys(products)
    if "title" in wanted:
        keys = keys.unionByName(title_hits(cart, products, threshold))
    joined = lines.join(keys, ["session_id", "kind", "key"])
    return joined.groupBy("session_id", "item_pos").agg(
        *[F.min(F.when(F.col("strategy") == METHODS.index(m), F.col("hit"))).alias(m) for m in wanted]
    )


def match_strategy(cart: DataFrame, products: DataFrame, method: str, threshold: float = DEFAULT_TITLE_THRESHOLD) -> DataFrame:
    """Matches of a single strategy: ``session_id, item_pos, product_pos, variant_pos, method, confidence, exact``."""
    name, confidence, exact = STRATEGIES[METHODS.index(method)]
    found = match_candidates(cart, products, threshold, [method])
    return found.select(
        "session_id",
        "item_pos",
        F.col(f"{name}.product_pos").alias("product_pos"),
        F.when(F.col(f"{name}.level") == 1, F.col(f"{name}.variant_pos")).alias("variant_pos"),
        F.lit(name).alias("method"),
        F.lit(confidence).alias("confidence"),
        F.lit(exact).alias("exact"),
    )


def match_signals(candidates: DataFrame) -> DataFrame:
    """Adds ``signals`` (high to low confidence, strategy order inside) and the primary match."""
    signal = "struct<method: string, confidence: string, exact: boolean>"
    signals = F.filter(
        F.array(
            *[
                F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("method"), F.lit(c).alias("confidence"), F.lit(e).alias("exact")))
                for n, c, e in STRATEGIES
            ]
        ),
        lambda s: s.isNotNull(),
    ).cast(f"array<{signal}>")
    hit = F.coalesce(*[F.col(n) for n in METHODS])
    return (
        candidates.withColumn("signals", signals)
        .withColumn("primary_hit", hit)
        .select(
            "session_id",
            "item_pos",
            "signals",
            F.get("signals", F.lit(0))["method"].alias("method"),
            F.get("signals", F.lit(0))["confidence"].alias("confidence"),
            F.col("primary_hit.product_pos").alias("product_pos"),
            F.when(F.col("primary_hit.level") == 1, F.col("primary_hit.variant_pos")).alias("variant_pos"),
        )
    )
