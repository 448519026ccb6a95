"""Cart events as one row per cart line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.text import js_trim, non_blank
from cartloom.operators.product_ids import extracted_ids
from cartloom.operators.product_views import coerce_store_id
from cartloom.sources.events import parse_cart_events

_NO_STRINGS = "cast(array() as array<string>)"


def _has_text(c: Column) -> Column:
    return F.coalesce(js_trim(c), F.lit("")) != ""


def is_valid_line(url: Column, name: Column, price: Column) -> Column:
    """A line counts when it has a URL, or a name and a price (zero included)."""
    return _has_text(url) | (_has_text(name) & price.isNotNull())


def cart_lines(events: DataFrame) -> DataFrame:
    """Raw lines with their position; the other columns of the event are kept."""
    kept = [c for c in events.columns if c != "e"]
    return events.select(
        *kept,
        coerce_store_id(F.col("e.store_id")).alias("store_id"),
        F.posexplode("e.product_list").alias("item_pos", "item"),
    ).select(*kept, "store_id", "item_pos", "item.*")


def cart_line_filter(lines: DataFrame) -> DataFrame:
    return lines.where(is_valid_line(F.col("url"), F.col("name"), F.col("item_price")))


def _first_per_url(items: Column) -> Column:
    """Valid entries of one event's list, first per URL; entries without URL all stay. Ids come from the URL alone, so
    equal ids without a URL cannot occur here."""
    tagged = F.transform(items, lambda x, i: F.struct(i.alias("item_pos"), x.alias("item")))
    valid = F.filter(tagged, lambda t: is_valid_line(t["item"]["url"], t["item"]["name"], t["item"]["item_price"]))
    urls = F.transform(valid, lambda t: F.coalesce(non_blank(t["item"]["url"]), F.concat(F.lit("\x00"), t["item_pos"].cast("string"))))
    return F.filter(valid, lambda t, i: F.array_position(urls, F.element_at(urls, i + 1)) == i + 1)


def normalize_cart_events(events: DataFrame, registry: DataFrame, extract_ids: bool = True) -> DataFrame:
    """Cart products of parsed events, deduplicated within their event before any URL is analysed."""
    kept = [c for c in events.columns if c != "e"]
    lines = events.select(
        *kept, coerce_store_id(F.col("e.store_id")).alias("store_id"), F.explode(_first_per_url(F.col("e.product_list"))).alias("t")
    ).select(
        *kept,
        F.col("t.item_pos").alias("item_pos"),
        non_blank(F.col("t.item.name")).alias("title"),
        non_blank(F.col("t.item.url")).alias("url"),
        non_blank(F.col("t.item.image_url")).alias("image_url"),
        "store_id",
        F.col("t.item.item_price").cast("bigint").alias("price"),
        F.col("t.item.quantity").cast("bigint").alias("quantity"),
        F.col("t.item.line_total").cast("bigint").alias("line_total"),
        F.expr(_NO_STRINGS).alias("product_ids"),
    )
    if extract_ids:
        lines = extracted_ids(lines, registry, "url", "store_id", "extracted_ids")
    else:
        lines = lines.withColumn("extracted_ids", F.expr(_NO_STRINGS))
    for kind in ("skus", "gtins", "mpns"):
        lines = lines.withColumn(kind, F.lit(None).cast("array<string>"))
    return lines


def cart_dedup(lines: DataFrame, event_col: str = "event_id", pos_col: str = "item_pos") -> DataFrame:
    """First line per URL, else per id list, within an event; lines without either all stay and nothing is summed.

    Keyless lines take no part in the grouping, so they cannot gather in one task.
    """
    key = F.coalesce(non_blank(F.col("url")), F.nullif(F.array_join("extracted_ids", "|"), F.lit("")))
    keyed = lines.withColumn("dedup_key", key)
    w = Window.partitionBy(event_col, "dedup_key").orderBy(pos_col)
    first = keyed.where(F.col("dedup_key").isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.unionByName(keyed.where(F.col("dedup_key").isNull())).drop("dedup_key")


def normalize_raw_carts(df: DataFrame, registry: DataFrame, raw_col: str = "raw", **options: bool) -> DataFrame:
    return normalize_cart_events(parse_cart_events(df, raw_col), registry, **options)


def batch_results(events: DataFrame, products: DataFrame, event_col: str = "event_id") -> DataFrame:
    """Per event: whether it could be read and how many products it gave; input of the batch summaries."""
    counted = products.groupBy(event_col).agg(F.count(F.lit(1)).alias("products"))
    return (
        events.select(event_col, F.col("e").isNotNull().alias("success"))
        .join(counted, event_col, "left")
        .withColumn("products", F.coalesce("products", F.lit(0)))
    )
