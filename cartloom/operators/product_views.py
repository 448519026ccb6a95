"""Product-view events as normalised products with variants and identifier sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.prices import amount_to_cents, is_number, price_currency, price_to_cents
from cartloom.functions.urls import settled
from cartloom.functions.text import blank_to_null, js_trim, non_blank, parse_integer, parse_number
from cartloom.operators.product_ids import extracted_ids, nested_ids
from cartloom.sources.events import parse_product_views, texts

VARIANT_FIELDS = "sku: string, url: string, image_url: string, price: bigint, currency: string, color: string"
_NO_STRINGS = "cast(array() as array<string>)"
_NO_VARIANTS = f"cast(array() as array<struct<{VARIANT_FIELDS}>>)"


def _list(c: Column) -> Column:
    return F.coalesce(c, F.expr(_NO_STRINGS))


def _kept(c: Column) -> Column:
    """Non-blank entries, untrimmed."""
    return F.filter(_list(c), lambda s: s.isNotNull() & (js_trim(s) != ""))


def first_text(v: Column) -> Column:
    """First string of a scalar-or-list field, trimmed; null when blank."""
    return blank_to_null(F.get(texts(v), F.lit(0)))


def all_texts(v: Column) -> Column:
    """All non-blank strings of a scalar-or-list field, trimmed."""
    return F.filter(F.transform(F.coalesce(texts(v), F.expr(_NO_STRINGS)), js_trim), lambda s: s != "")


def first_number(v: Column) -> Column:
    """Number of a number, text or list field; texts count by their numeric prefix."""

    def scalar(x: Column) -> Column:
        return F.when(is_number(x), F.try_variant_get(x, "$", "double")).when(
            F.schema_of_variant(x) == "STRING", parse_number(F.try_variant_get(x, "$", "string"))
        )

    return F.when(
        F.schema_of_variant(v).startswith("ARRAY"), scalar(F.try_variant_get(v, "$[0]", "variant"))
    ).otherwise(scalar(v))


def coerce_store_id(v: Column) -> Column:
    """Store id as text: numbers are printed, texts trimmed, blanks dropped."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "string")).when(
        F.schema_of_variant(v) == "STRING", blank_to_null(F.try_variant_get(v, "$", "string"))
    )


def _map_texts(m: Column) -> Column:
    return F.coalesce(_kept(F.flatten(F.transform(F.map_values(m), texts))), F.expr(_NO_STRINGS))


def identifiers(e: str = "e") -> dict[str, Column]:
    """Ordered distinct SKUs, GTINs, MPNs and product ids from all the places an event can carry them."""

    def joined(*lists: Column) -> Column:
        return F.array_distinct(F.concat(*lists))

    return {
        "skus": joined(
            _kept(F.col(f"{e}.sku")),
            _kept(F.col(f"{e}.sku_list")),
            _kept(F.col(f"{e}.offers.sku")),
            _kept(F.col(f"{e}.offer_list.offer_sku")),
            _map_texts(F.col(f"{e}.urlToSku")),
            _map_texts(F.col(f"{e}.priceToSku")),
        ),
        "gtins": joined(_kept(F.col(f"{e}.gtin")), _kept(F.col(f"{e}.gtin_list"))),
        "mpns": joined(_kept(F.col(f"{e}.mpn")), _kept(F.col(f"{e}.mpn_list"))),
        "product_ids": joined(_kept(F.col(f"{e}.productID")), _kept(F.col(f"{e}.productid_list"))),
    }


def _variant(sku: Column, url: Column, image: Column, price: Column, currency: Column, color: Column) -> Column:
    return F.struct(
        sku.alias("sku"),
        F.nullif(url, F.lit("")).alias("url"),
        non_blank(image).alias("image_url"),
        price.cast("bigint").alias("price"),
        F.nullif(currency, F.lit("")).alias("currency"),
        non_blank(color).alias("color"),
    )


_PREPARED = ["skus", "gtins", "mpns", "product_ids", "urls", "images", "colors", "prices", "offer_variants", "listed_variants"]


def prepare_views(events: DataFrame, e: str = "e") -> DataFrame:
    """Adds the lists that variants are built from, computed once per event.

    They are settled, because the variant rules look them up inside per-element functions, where an expression that is
    merely a column of an earlier projection would be evaluated again for every element.
    """
    prices = F.transform(
        f"{e}.price", lambda p: F.struct(price_to_cents(p).alias("cents"), price_currency(p).alias("currency"))
    )
    lists = {
        **identifiers(e),
        "urls": all_texts(F.col(f"{e}.url")),
        "images": F.coalesce(F.col(f"{e}.image"), F.col(f"{e}.image_url_list"), F.expr(_NO_STRINGS)),
        "colors": F.concat(all_texts(F.col(f"{e}.color")), _list(F.col(f"{e}.color_list"))),
        "prices": prices,
        "offer_variants": variants_from_offers(e),
        "listed_variants": variants_from_offer_list(e),
    }
    return settled(events.select("*", *[c.alias(n) for n, c in lists.items()]), *_PREPARED)


def variants_from_url_map(e: str = "e") -> Column:
    """One variant per URL and SKU of the URL map; image, colour and price by the URL's place in the URL list."""

    def of_entry(entry: Column) -> Column:
        at = (F.array_position("urls", entry["key"]) - 1).cast("int")
        return F.transform(
            _kept(texts(entry["value"])),
            lambda sku: _variant(
                sku,
                entry["key"],
                F.get("images", at),
                F.get("prices", at)["cents"],
                F.get("prices", at)["currency"],
                F.get("colors", at),
            ),
        )

    return F.coalesce(F.flatten(F.transform(F.map_entries(f"{e}.urlToSku"), of_entry)), F.expr(_NO_VARIANTS))


def variants_from_offers(e: str = "e") -> Column:
    """One variant per toolbar offer that names a SKU."""
    none = F.lit(None).cast("string")
    return F.coalesce(
        F.transform(
            F.filter(f"{e}.offers", lambda o: o["sku"] != ""),
            lambda o: _variant(o["sku"], o["url"], none, price_to_cents(o["price"]), price_currency(o["price"]), none),
        ),
        F.expr(_NO_VARIANTS),
    )


def variants_from_offer_list(e: str = "e") -> Column:
    """One variant per app offer that names a SKU."""
    none = F.lit(None).cast("string")
    return F.coalesce(
        F.transform(
            F.filter(f"{e}.offer_list", lambda o: o["offer_sku"] != ""),
            lambda o: _variant(o["offer_sku"], none, none, amount_to_cents(o["offer_amount"]), o["offer_currency"], none),
        ),
        F.expr(_NO_VARIANTS),
    )


def variants_from_parallel_arrays() -> Column:
    """One variant per distinct SKU; the SKU's last offer comes first, then the side lists by position."""

    def of_sku(sku: Column, i: Column) -> Column:
        def last(offers: str) -> Column:
            return F.try_element_at(F.filter(offers, lambda o: o["sku"] == sku), F.lit(-1))

        offer = F.coalesce(last("listed_variants"), last("offer_variants"))
        price = F.get("prices", i)
        return _variant(
            sku,
            F.coalesce(offer["url"], F.get("urls", i)),
            F.get("images", i),
            F.coalesce(offer["price"], price["cents"]),
            F.coalesce(offer["currency"], F.when(offer["price"].isNull(), price["currency"])),
            F.get("colors", i),
        )

    return F.transform("skus", of_sku)


def choose_variants(e: str = "e") -> Column:
    """Variants of the best source an event has: URL map, offers, offer list, parallel lists."""
    has_map = F.size(F.coalesce(F.map_keys(f"{e}.urlToSku"), F.expr(_NO_STRINGS))) > 0
    return (
        F.when(has_map, variants_from_url_map(e))
        .when(F.size("offer_variants") > 0, F.col("offer_variants"))
        .when(F.size("listed_variants") > 0, F.col("listed_variants"))
        .when(F.size("skus") > 0, variants_from_parallel_arrays())
        .otherwise(F.expr(_NO_VARIANTS))
    )


def with_chosen_variants(prepared: DataFrame) -> DataFrame:
    """Adds ``variants``: the chosen ones, first per SKU."""
    chosen = settled(prepared.withColumn("variants", choose_variants()), "variants")
    skus = F.col("variants.sku")
    return chosen.withColumn("variants", F.filter("variants", lambda v, i: F.array_position(skus, v["sku"]) == i + 1))


def primary_price(e: str = "e") -> Column:
    """``struct<price, currency>`` from the first source that has a price: offers, offer list, price list, cents list."""

    def pair(price: Column, currency: Column) -> Column:
        return F.when(price.isNotNull(), F.struct(price.cast("bigint").alias("price"), currency.alias("currency")))

    offer = F.get(f"{e}.offers", F.lit(0))
    listed = F.get(f"{e}.offer_list", F.lit(0))
    price = F.get(f"{e}.price", F.lit(0))
    cents = F.get(f"{e}.priceInCents", F.lit(0))
    currency = F.get(f"{e}.priceCurrency", F.lit(0))
    cents_value = F.when(is_number(cents), F.try_variant_get(cents, "$", "double").cast("bigint")).otherwise(
        parse_integer(F.try_variant_get(cents, "$", "string"))
    )
    return F.coalesce(
        pair(price_to_cents(offer["price"]), price_currency(offer["price"])),
        pair(amount_to_cents(listed["offer_amount"]), listed["offer_currency"]),
        pair(price_to_cents(price), F.coalesce(price_currency(price), currency)),
        pair(cents_value, currency),
    )


def primary_fields(e: str = "e") -> dict[str, Column]:
    """Title, URL, image, brand, category and colour by their order of preference."""

    def head(field: str) -> Column:
        return non_blank(F.get(f"{e}.{field}", F.lit(0)))

    return {
        "title": first_text(F.col(f"{e}.name")),
        "url": F.coalesce(
            head("canonical"), first_text(F.col(f"{e}.url")), non_blank(F.col(f"{e}.product_url")), non_blank(F.col(f"{e}.page_url"))
        ),
        "image_url": F.coalesce(head("image"), non_blank(F.col(f"{e}.image_url")), head("image_url_list")),
        "brand": F.coalesce(first_text(F.col(f"{e}.brand")), head("brand_list")),
        "description": first_text(F.col(f"{e}.description")),
        "category": F.coalesce(first_text(F.col(f"{e}.category")), first_text(F.col(f"{e}.breadcrumbs"))),
        "color": F.coalesce(first_text(F.col(f"{e}.color")), head("color_list")),
    }


def normalize_product_views(
    events: DataFrame,
    registry: DataFrame,
    extract_ids: bool = True,
    include_metadata: bool = True,
    variant_ids: bool = True,
) -> DataFrame:
    """One normalised product per parsed event; all other input columns are kept. Events that could not be read give none.

    The ids of variant URLs are worked out within the event's row, so the job needs no shuffle and suits streams. Only a registry too large
    for that (``registry.MOST_ENTRIES``) makes them rows of their own; then ``event_id`` must be unique, and a stream is refused.
    Without ``variant_ids`` only the product's own URL is analysed.
    """
    product = _products(events.where(F.col("e").isNotNull()), include_metadata)
    if extract_ids:
        # settled, since the many steps of the URL would each work out again which of the event's URLs it is
        product = settled(product, "url", "store_id").select(*product.columns)
        product = extracted_ids(product, registry, "url", "store_id", "extracted_ids")
    else:
        product = product.withColumn("extracted_ids", F.expr(_NO_STRINGS))
    if extract_ids and variant_ids:
        product = _with_variant_ids(product, registry)
    else:
        product = product.withColumn("variants", F.transform("variants", _without_ids))
    return product.withColumn("variant_count", F.size("variants")).withColumn("has_variants", F.col("variant_count") > 1)


def _products(events: DataFrame, include_metadata: bool) -> DataFrame:
    kept = [c for c in events.columns if c != "e"]
    fields = primary_fields()
    shaped = with_chosen_variants(prepare_views(events)).select(
        *kept,
        fields["title"].alias("title"),
        fields["url"].alias("url"),
        F.lit(None).cast("string").alias("canonical_url"),
        fields["image_url"].alias("image_url"),
        coerce_store_id(F.col("e.store_id")).alias("store_id"),
        F.nullif(F.col("e.store_name"), F.lit("")).alias("store_name"),
        *[fields[n].alias(n) for n in ("brand", "description", "category", "color")],
        first_number(F.col("e.rating")).alias("rating"),
        primary_price().alias("pp"),
        "variants",
        "skus",
        "gtins",
        "mpns",
        "product_ids",
    ).select(
        "*",
        F.col("pp.price").alias("price"),
        F.nullif(F.col("pp.currency"), F.lit("")).alias("currency"),
    ).drop("pp")
    for kind in ("skus", "gtins", "mpns"):
        shaped = shaped.withColumn(kind, F.when(F.size(kind) > 0, F.col(kind)))
    if not include_metadata:
        for name in ("brand", "description", "category", "color", "rating", "price", "currency"):
            shaped = shaped.withColumn(name, F.lit(None).cast(shaped.schema[name].dataType))
        for kind in ("skus", "gtins", "mpns"):
            shaped = shaped.withColumn(kind, F.lit(None).cast("array<string>"))
    return shaped


def _without_ids(v: Column) -> Column:
    return v.withField("extracted_ids", F.lit(None).cast("array<string>"))


def _with_variant_ids(products: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the ids of every variant URL; each distinct URL of an event is analysed once."""
    urls = F.filter(F.array_distinct(F.col("variants.url")), lambda u: u.isNotNull())
    found = nested_ids(F.col("variant_urls"), F.col("store_id"), registry)
    if found is None:
        if products.isStreaming:
            raise ValueError("a registry of this size can't be looked up within the rows of a stream")
        return _with_joined_variant_ids(products, registry)
    listed = settled(products.withColumn("variant_urls", urls), "variant_urls", "store_id", "variants")
    analysed = settled(listed.withColumn("variant_found", found), "variant_found")

    def with_ids(v: Column) -> Column:
        ids = F.get("variant_found", (F.array_position("variant_urls", v["url"]) - 1).cast("int"))
        return v.withField("extracted_ids", F.when(F.size(ids) > 0, ids))

    return analysed.withColumn("variants", F.transform("variants", with_ids)).select(*products.columns)


def _with_joined_variant_ids(products: DataFrame, registry: DataFrame) -> DataFrame:
    """The same for a registry of any size: variants are exploded, analysed like any URL and put back in order.

    A group is the variants of a single event, so its size is bounded by one JSON record.
    """
    exploded = products.where(F.size("variants") > 0).select(
        "event_id", "store_id", F.posexplode("variants").alias("pos", "v")
    ).withColumn("variant_url", F.col("v.url"))
    found = extracted_ids(exploded, registry, "variant_url", "store_id", "ids")
    back = found.groupBy("event_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("pos", F.col("v").withField("extracted_ids", F.when(F.size("ids") > 0, F.col("ids"))).alias("v"))
            )
        ).alias("sorted")
    )
    joined = products.join(back, "event_id", "left")
    empty = F.transform("variants", _without_ids)
    return joined.withColumn("variants", F.coalesce(F.col("sorted.v"), empty)).drop("sorted").select(
        *products.columns
    )


def product_variants(products: DataFrame, *keys: str) -> DataFrame:
    """Variant-grain table; products without variants keep one row."""
    keys = keys or ("event_id",)
    return products.select(
        *keys, "variant_count", "has_variants", F.posexplode_outer("variants").alias("variant_pos", "v")
    ).select(*keys, "variant_count", "has_variants", "variant_pos", "v.*")


def normalize_raw_views(df: DataFrame, registry: DataFrame, raw_col: str = "raw", **options: bool) -> DataFrame:
    return normalize_product_views(parse_product_views(df, raw_col), registry, **options)
