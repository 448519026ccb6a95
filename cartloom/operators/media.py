"""ASIN lookups and product image downloads as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.text import js_trim, parse_integer
from cartloom.functions.urls import with_url_parts

# What counts as a usable image and how response codes are read.
ALLOWED_TYPES = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
MIN_BYTES, MAX_BYTES = 1024, 10 * 1024 * 1024
PERMANENT_STATUS = [400, 401, 403, 404, 405, 410, 414, 415, 451]
STATUS_CODES = {401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND", 410: "GONE", 429: "RATE_LIMITED"}
IDENTIFIERS = ["upc", "sku", "mpn"]


def asin_to_identifiers(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Identifiers per requested ASIN from the first product of its mapping; empty identifiers are dropped.

    ``mapping`` has one row per (asin, product_pos) with ``error_id, error_title, upc, sku, mpn``.
    """
    row = F.struct("error_id", "error_title", *[F.nullif(F.col(i), F.lit("")).alias(i) for i in IDENTIFIERS])
    first = mapping.groupBy("asin").agg(F.min_by(row, "product_pos").alias("m"))
    joined = requests.join(first, "asin", "left")
    error = (
        F.when(F.col("asin") == "", F.lit("InvalidInputError"))
        .when(F.col("m.error_id") == "product_not_found", F.lit("ProductNotFoundError"))
        .when(F.col("m.error_id").isNotNull(), F.lit("ApiResponseError"))
    )
    message = (
        F.when(F.col("asin") == "", F.lit("Invalid ASINs provided"))
        .when(F.col("m.error_id") == "product_not_found", F.concat(F.lit("Product not found for ASIN: "), "asin"))
        .when(F.col("m.error_id").isNotNull(), F.concat(F.lit("API error: "), F.coalesce("m.error_title", "m.error_id")))
    )
    return joined.withColumn("error", error).select(
        *requests.columns,
        *[F.when(F.col("error").isNull(), F.col(f"m.{i}")).alias(i) for i in IDENTIFIERS],
        F.col("error").isNull().alias("success"),
        "error",
        message.alias("message"),
    )


def media_type(c: Column) -> Column:
    """Content type without parameters, lower-cased."""
    return js_trim(F.substring_index(F.lower(F.coalesce(c, F.lit(""))), ";", 1))


def file_extension(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ALLOWED_TYPES.items() for x in kv])
    sub = F.get(F.split(media_type(c), "/"), F.lit(1))
    return F.coalesce(F.try_element_at(known, media_type(c)), sub, F.lit("bin"))


def _with_domain(df: DataFrame, url_col: str) -> DataFrame:
    parts = with_url_parts(df, url_col)
    return parts.withColumn("valid_url", F.col("u_error").isNull()).withColumn(
        "domain", F.when(F.col("valid_url"), F.regexp_replace("u_host", r"\.$", "")).otherwise(F.lit("unknown"))
    ).select(*df.columns, "valid_url", "domain")


def image_manifest(requests: DataFrame, base_path: str) -> DataFrame:
    """Distinct image requests with validity, domain and the path the image is stored under."""
    distinct = requests.select("store_id", "image_url", "content_type").distinct()
    name = F.concat(F.substring(F.sha2("image_url", 256), 1, 16), F.lit("."), file_extension(F.col("content_type")))
    return _with_domain(distinct, "image_url").withColumn(
        "storage_path", F.when(F.col("valid_url"), F.concat_ws("/", F.lit(base_path), "store_id", name))
    )


def _size_error(size: Column) -> Column:
    return F.when(size < MIN_BYTES, F.lit("IMAGE_TOO_SMALL")).when(size > MAX_BYTES, F.lit("IMAGE_TOO_LARGE"))


def image_response_classify(log: DataFrame) -> DataFrame:
    """Outcome of every download: status, content type, announced size, then stored size decide in this order."""
    code = F.lit("SERVER_ERROR")
    for status, name in STATUS_CODES.items():
        code = F.when(F.col("status") == status, F.lit(name)).otherwise(code)
    failed_status = (F.col("status") < 200) | (F.col("status") > 299)
    error = (
        F.when(~F.col("valid_url"), F.lit("INVALID_URL"))
        .when(failed_status, code)
        .when(~media_type(F.col("content_type")).isin(list(ALLOWED_TYPES)), F.lit("INVALID_CONTENT_TYPE"))
        .otherwise(F.coalesce(_size_error(parse_integer(F.col("content_length"))), _size_error(F.col("size_bytes"))))
    )
    out = _with_domain(log, "image_url").withColumn("error_code", error)
    permanent = F.when(F.col("valid_url") & failed_status, F.col("status").isin(PERMANENT_STATUS)).otherwise(F.lit(True))
    return out.withColumn("success", F.col("error_code").isNull()).withColumn(
        "is_permanent", F.when(F.col("error_code").isNotNull(), permanent)
    )


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds from a Retry-After header: a positive number, or the time left until an HTTP date."""
    seconds = parse_integer(value)
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    left = F.ceil(date.cast("double") - now.cast("double")).cast("long")
    return F.when(seconds > 0, seconds).when(left > 0, left)


def image_retry_queue(log: DataFrame, now_col: str = "fetched_at") -> DataFrame:
    """Downloads worth another try, with the wait their server asked for."""
    failed = image_response_classify(log).where(~F.col("success") & ~F.col("is_permanent"))
    return failed.withColumn("retry_seconds", retry_after_seconds(F.col("retry_after"), F.col(now_col)))


def image_batch_summary(classified: DataFrame) -> DataFrame:
    """Downloads by domain and outcome."""
    return classified.groupBy("domain", F.coalesce("error_code", F.lit("OK")).alias("code")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed")
    )
