"""Raw client events: one JSON object per line.

Fields that clients send either as a scalar or as a list are declared VARIANT, everything else is typed. The schema is
declared once and serves files, tables with a JSON text column, and streams alike; Spark parses only the fields a job uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.urls import settled

_CONTEXT = (
    "app_version string, application_type string, application_subtype string, browser string, browser_agent string, "
    "client string, platform string, page_url string, session_id bigint, tenant string, timestamp bigint, toolbarid bigint, "
    "tracking_ticket string, member_guid string, user_id string, visit_id string, device_platform string, os_version string, "
    "created_ts string, created_ts_ms string, "
    "context_device struct<id: string, manufacturer: string, model: string, name: string, type: string, "
    "adTrackingEnabled: boolean, advertisingId: string>, "
    "context_location struct<latitude: double, longitude: double>, "
    "context_network struct<carrier: string, cellular: boolean, wifi: boolean, bluetooth: boolean>, "
    "context_os struct<name: string, version: string>, context_timezone string, device_ids map<string, string>, "
    "app_install_ts bigint"
)

PRODUCT_VIEW_SCHEMA = (
    "store_id variant, store_name string, name variant, url variant, product_url string, image array<string>, "
    "image_url string, image_url_list array<string>, sku array<string>, sku_list array<string>, gtin array<string>, "
    "gtin_list array<string>, productID array<string>, productid_list array<string>, mpn array<string>, "
    "mpn_list array<string>, model array<string>, model_list array<string>, "
    "offers array<struct<price: variant, sku: string, url: string>>, "
    "offer_list array<struct<offer_amount: variant, offer_currency: string, offer_sku: string>>, "
    "urlToSku map<string, variant>, priceToSku map<string, variant>, price array<variant>, priceInCents array<variant>, "
    "priceCurrency array<string>, brand variant, brand_list array<string>, rating variant, description variant, "
    "category variant, breadcrumbs variant, canonical array<string>, color variant, color_list array<string>, " + _CONTEXT
)

CART_SCHEMA = (
    "store_id variant, store_name string, product_list array<struct<name: string, url: string, image_url: string, "
    "item_price: double, line_total: double, quantity: double>>, cart_total double, cart_total_qty double, currency string, "
    "url string, free_shipping boolean, " + _CONTEXT
)

# The JSON kinds each checked field may have, as patterns over variant type names.
_TEXT, _NUMBER = "STRING", "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)"
_TEXTS = "ARRAY<(STRING|VOID)>"
_OBJECTS = "ARRAY<(VOID|OBJECT.*)>"
PRODUCT_VIEW_KINDS = {
    "store_id": f"({_TEXT}|{_NUMBER})",
    "store_name": _TEXT,
    **{f: f"({_TEXT}|{_TEXTS})" for f in ("name", "url", "brand", "description", "category", "breadcrumbs", "color")},
    **{f: _TEXT for f in ("product_url", "page_url", "image_url", "created_ts")},
    **{
        f: _TEXTS
        for f in (
            "image", "image_url_list", "sku", "sku_list", "gtin", "gtin_list", "mpn", "mpn_list", "productID",
            "productid_list", "model", "model_list", "brand_list", "color_list", "canonical", "priceCurrency",
        )
    },
    "offers": _OBJECTS,
    "offer_list": _OBJECTS,
    "urlToSku": "OBJECT.*",
    "priceToSku": "OBJECT.*",
    "price": "ARRAY.*",
    "priceInCents": "ARRAY.*",
    "rating": f"({_TEXT}|{_NUMBER}|ARRAY.*)",
    "session_id": _NUMBER,
    "timestamp": _NUMBER,
}
CART_KINDS = {
    "store_id": f"({_TEXT}|{_NUMBER})",
    "store_name": _TEXT,
    "product_list": _OBJECTS,
    "cart_total": _NUMBER,
    "cart_total_qty": _NUMBER,
    "currency": _TEXT,
    "page_url": _TEXT,
    "created_ts": _TEXT,
    "session_id": _NUMBER,
    "timestamp": _NUMBER,
}


def texts(v: Column) -> Column:
    """The strings of a scalar-or-list variant; other kinds give none."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string")))
        .when(kind.startswith("ARRAY"), F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull()))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )


def _is_object(raw_col: str) -> Column:
    # of texts that are JSON the first character tells the kind, so the schema of the whole need not be worked out
    return F.try_parse_json(raw_col).isNotNull() & F.ltrim(raw_col, F.lit(" \t\n\r")).startswith("{")


def parse_product_views(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Replaces a JSON text column by the typed event struct ``e``, which is null where the text is no JSON object."""
    # settled, so that the text is parsed once and not once for each field read later
    return settled(df.withColumn("e", F.when(_is_object(raw_col), F.from_json(raw_col, PRODUCT_VIEW_SCHEMA))).drop(raw_col), "e")


def parse_cart_events(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Replaces a JSON text column by the typed event struct ``e``; a missing product list reads as empty, and the struct is null where the
    text is no JSON object."""
    parsed = df.withColumn("e", F.when(_is_object(raw_col), F.from_json(raw_col, CART_SCHEMA))).drop(raw_col)
    listed = F.coalesce(F.col("e.product_list"), F.from_json(F.lit("[]"), "array<" + _item_type() + ">"))
    return settled(parsed.withColumn("e", F.when(F.col("e").isNotNull(), F.col("e").withField("product_list", listed))), "e")


def _item_type() -> str:
    return "struct<name: string, url: string, image_url: string, item_price: double, line_total: double, quantity: double>"


def read_product_views(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines files of product-view events as rows of ``e``."""
    reader = spark.readStream if streaming else spark.read
    return parse_product_views(reader.text(path).withColumnRenamed("value", "raw"))


def read_cart_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines files of cart events as rows of ``e``."""
    reader = spark.readStream if streaming else spark.read
    return parse_cart_events(reader.text(path).withColumnRenamed("value", "raw"))


def event_violations(df: DataFrame, kinds: dict[str, str] = PRODUCT_VIEW_KINDS, raw_col: str = "raw") -> DataFrame:
    """Adds ``violations``: the fields whose JSON kind the event schema does not allow; ``$`` when the text is no object."""
    # settled, so that the text is parsed once and not once for each field
    parsed = settled(df.withColumn("v_", F.try_parse_json(raw_col)), "v_")
    v = F.col("v_")
    checks = [
        F.when(~F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).rlike(f"^{pattern}$"), F.lit(f))
        for f, pattern in kinds.items()
    ]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return parsed.withColumn("violations", F.when(is_object, found).otherwise(F.array(F.lit("$")))).drop("v_")


def validate_events(
    df: DataFrame, kinds: dict[str, str] = PRODUCT_VIEW_KINDS, raw_col: str = "raw"
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the reason)."""
    checked = event_violations(df, kinds, raw_col)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    rejected = checked.where(F.size("violations") > 0).withColumn("reason", F.array_join("violations", ",")).drop("violations")
    return valid, rejected
