"""Registered queries for sources, dimensions, coverage, JSON-LD, ASIN and image tables, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators import coverage, jsonld, media
from cartloom.operators.product_ids import result_summary, url_analysis
from cartloom.operators.product_views import product_variants
from cartloom.plans.adapters import session_views, table, view
from cartloom.plans.url_queries import Query, all_urls, joined
from cartloom.session import scratch_dir
from cartloom.sources import files
from cartloom.sources import registry as reg
from cartloom.sources import registry_versions as versions
from cartloom.streaming import corrections, jobs


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "store_registry")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.catalog_from_table(view(spark, sf_dir, "store_catalog"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.store_row_stats(view(spark, sf_dir, "url_log"), "row_id")


def read_url_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL log through CSV files with other column names in the shared folder."""
    path = scratch_dir(spark, "log")
    log = view(spark, sf_dir, "url_log").select(F.col("url").alias("URL"), F.col("store_id").alias("Merchant_ID"), F.col("url_ids_csv").alias("IDS"))
    log.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    back = files.read_url_log(spark, path)
    return back.groupBy(F.trim("store_id").alias("store_id")).agg(F.count(F.lit(1)).alias("row_count"), F.count(F.nullif(F.trim("url_ids_csv"), F.lit(""))).alias("with_ids"))


def read_url_log_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL log through CSV files in which some rows lack cells, some have too many, and some hold a line break: what is read, what is put aside."""
    path = scratch_dir(spark, "faulty-log")
    k = F.split("row_id", "-")[0].cast("long") % 17
    cells = [F.coalesce(c, F.lit("")) for c in ("url", "store_id")]
    ids = F.concat(F.lit('"'), F.coalesce("url_ids_csv", F.lit("")), F.when(k == 7, F.lit("\n,")).otherwise(F.lit("")), F.lit('"'))
    line = F.when(k == 3, cells[0]).when(k == 5, F.concat_ws(",", *cells, ids, F.lit("more"), F.lit('"and, more"'))).when(k == 9, F.concat_ws(",", *cells, F.lit('a"b"c'), F.lit("d"))).otherwise(F.concat_ws(",", *cells, ids))
    log = view(spark, sf_dir, "url_log").filter("url <> ''").select(line.alias("value"))
    # each file begins with the header
    width = 8
    header = spark.range(0, width, 1, width).select(F.lit(-1).alias("n"), F.lit("URL,Merchant_ID,IDS").alias("value"), F.col("id").cast("int").alias("part"))
    rows = log.select(F.lit(0).alias("n"), "value", F.pmod(F.hash("value"), F.lit(width)).alias("part"))
    header.unionByName(rows).repartition(width, "part").sortWithinPartitions("part", "n").select("part", "value").write.partitionBy("part").text(path)
    whole, faulty = files.read_url_log_checked(spark, f"{path}/part=*")
    counted = whole.select(F.lit("whole").alias("fault"), F.length(F.regexp_replace("url_ids_csv", r"[^\n]", "")).alias("breaks")).unionByName(faulty.select("fault", F.lit(0).alias("breaks")))
    return counted.groupBy("fault").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("breaks"), F.lit(0)).cast("long").alias("breaks"))


def read_store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog through JSON documents, one per line, in the shared folder."""
    path = scratch_dir(spark, "catalog")
    entry = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"name":"'), "name", F.lit('","attributes":'), "attributes", F.lit("}"))
    docs = view(spark, sf_dir, "store_catalog").select(F.concat(F.lit('{"@rows":"1","@total":"1","store":['), entry, F.lit("]}")).alias("value"))
    docs.write.text(path)
    return files.read_store_catalog(spark, path, one_per_line=True).select("id", "name", "product_search_enabled")


def read_golden_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases through one JSON document per case."""
    path = scratch_dir(spark, "golden")
    doc = F.to_json(F.struct(F.col("store_name").alias("name"), F.col("store_id").alias("id"), F.array(F.struct("url", F.col("expected_skus").alias("expectedSkus"))).alias("testCases")))
    view(spark, sf_dir, "golden_urls").select(doc.alias("value")).write.text(path)
    cases = files.read_golden_urls(spark, path, one_per_line=True)
    return cases.groupBy(F.col("store_name").alias("name")).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("expected_skus")).alias("skus"))


def dim_store_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.dim_store_by_id(_registry(spark, sf_dir)).select("store_id", "primary_id", "primary_domain", joined("path_patterns").alias("path_patterns"), "rewrite_to")


def dim_store_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.dim_store_by_domain(_registry(spark, sf_dir)).select("store_domain", "primary_id", "primary_domain")


def dim_store_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.dim_store_name(_registry(spark, sf_dir))


def dim_store_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.dim_store_patterns(_registry(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "url_log").select("row_id", F.trim("store_id").alias("store_id"), F.regexp_extract("url", r"www\.([^/]+)", 1).alias("domain"))
    return reg.store_lookup(log, _registry(spark, sf_dir)).select("row_id", "store_id", "primary_id", "primary_domain")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly registries, written as snapshots and read back."""
    path, weekly = scratch_dir(spark, "registry"), view(spark, sf_dir, "registry_snapshots")
    time = F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss")
    for (week,) in weekly.select(time).distinct().collect():
        versions.write_registry_snapshot(weekly.filter(time == week).drop("valid_from"), path, week)
    return versions.read_registry_snapshots(spark, path)


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the settings of each store id and domain changed."""
    found = versions.registry_versions(_snapshots(spark, sf_dir))
    times = [F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("valid_from", "valid_to")]
    return found.select("kind", "key", *times, F.col("config").isNull().alias("is_gone"), "config.primary_id", "config.primary_domain", "config.rewrite_to")


def store_lookup_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the visited stores as of the visit."""
    visits = view(spark, sf_dir, "store_visits").withColumn("ts", F.col("ts").cast("timestamp"))
    found = versions.store_lookup_at(visits, versions.registry_versions(_snapshots(spark, sf_dir)), "ts")
    return found.select("event_id", "store_id", "primary_id", "primary_domain", "rewrite_to")


def url_log_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every logged URL against the registry with one store per supplier."""
    log = view(spark, sf_dir, "url_log").select("row_id", "url", F.trim("store_id").alias("store_id"))
    found = url_analysis(log, _registry(spark, sf_dir))
    return found.select("row_id", "store_id", joined("product_ids").alias("product_ids"), "success")


def catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "url_log").select(F.col("store_id")).distinct()
    return files.catalog_lookup(asked, _catalog(spark, sf_dir))


def catalog_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.catalog_enabled(_catalog(spark, sf_dir))


def write_catalog_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dates, the first of them written twice: both stay, and the totals are those of the last written one."""
    path, catalog = scratch_dir(spark, "snapshot"), _catalog(spark, sf_dir)
    files.write_catalog_snapshot(catalog, path, "2025-01-30")
    files.write_catalog_snapshot(catalog.where("product_search_enabled"), path, "2025-01-30")
    totals = files.write_catalog_snapshot(catalog, path, "2025-01-31")
    history = spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("stores"))
    return history.join(totals.withColumn("snapshot_date", F.col("snapshot_date").cast("string")), "snapshot_date", "left")


def write_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "report")
    files.write_report(_stats(spark, sf_dir), path, "url_log")
    return spark.read.parquet(path)


def coverage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered, missing = coverage.coverage_split(_stats(spark, sf_dir), _registry(spark, sf_dir))
    return covered.select("store_id", F.lit(True).alias("covered")).unionByName(missing.select("store_id", F.lit(False).alias("covered")))


def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_totals(_stats(spark, sf_dir), _registry(spark, sf_dir))


def coverage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_breakdown(_stats(spark, sf_dir), _registry(spark, sf_dir))


def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.catalog_coverage(_catalog(spark, sf_dir), _registry(spark, sf_dir))


def registry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.registry_issues(_catalog(spark, sf_dir), _registry(spark, sf_dir))


def url_log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.url_log_gaps(view(spark, sf_dir, "url_log"), since="1998-01-01", no_ids=True, no_products=True)


def jsonld_product_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.jsonld_product_filter(view(spark, sf_dir, "jsonld_docs")).select("doc_id", "is_product", joined("reasons").alias("reasons"))


def jsonld_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.jsonld_skus(view(spark, sf_dir, "jsonld_docs")).select("doc_id", joined("skus").alias("skus"))


def jsonld_product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.jsonld_product_summary(view(spark, sf_dir, "jsonld_docs")).withColumn("skus", joined("skus")).select("doc_id", "name", "brand", "description", "skus")


def _asins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.asin_to_identifiers(view(spark, sf_dir, "asin_requests"), view(spark, sf_dir, "asin_mapping"))


def asin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_summary(_asins(spark, sf_dir))


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_manifest(view(spark, sf_dir, "fetch_log"), "images")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_response_classify(view(spark, sf_dir, "fetch_log"))


def image_response_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("request_id", "success", "error_code", "is_permanent", "domain")


def image_retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_retry_queue(view(spark, sf_dir, "fetch_log")).select("request_id", "error_code", "retry_seconds")


def image_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_batch_summary(_classified(spark, sf_dir))


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available and returns what it wrote."""
    path = scratch_dir(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _as_stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def stream_normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _as_stream(spark, view(spark, sf_dir, "raw_carts"), "carts-in")
    out = _drained(spark, jobs.stream_normalize_carts(stream, reg.builtin_registry(spark)), "carts-out")
    return out.select("event_id", F.col("item_pos").cast("long").alias("item_pos"), "title", "url", "price", joined("extracted_ids").alias("extracted_ids"))


def stream_product_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product views of a stream at variant grain, with the ids of the variants' URLs."""
    stream = _as_stream(spark, view(spark, sf_dir, "raw_views"), "views-in")
    out = _drained(spark, jobs.stream_normalize_views(stream, reg.builtin_registry(spark)), "views-out")
    variants = product_variants(out)
    return variants.select("event_id", F.col("variant_pos").cast("long").alias("variant_pos"), "sku", "url", "price", joined("extracted_ids").alias("extracted_ids"))


def _timed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits of page URLs: the event id picks one of all pages."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.agg(F.max("page_id")).first()[0] + 1
    return events.join(pages, F.col("event_id") % n_pages == F.col("page_id")).select("event_id", "ts", "url")


def stream_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _as_stream(spark, _timed_urls(spark, sf_dir), "urls-in")
    out = _drained(spark, jobs.stream_url_dedup(stream, "ts", "1 day"), "urls-out")
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def stream_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _as_stream(spark, _timed_urls(spark, sf_dir), "visits-in")
    summary = jobs.stream_batch_summary(stream, reg.builtin_registry(spark), "ts", "1 day", "1 hour")
    closed = _drained(spark, summary, "visits-out")
    return closed.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "total", "successful", "failed")


def stream_session_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carts of the sessions that closed in a stream of order events: every other order has a second event half an hour later, and the
    orders of the last day are still open."""
    carts, products = session_views(spark, sf_dir, "cart_lines", "viewed_products")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    orders = orders.unionByName(orders.where("session_id % 2 = 0").withColumn("ts", F.col("ts") + F.expr("interval 30 minutes")))
    path = scratch_dir(spark, "sessions")
    closed = jobs.closed_sessions(_as_stream(spark, orders, "orders-in"), "ts", "30 minutes", "1 hour")

    def keep(enriched: DataFrame, batch_id: int) -> None:
        enriched.drop("enriched_at").write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    query = jobs.stream_session_enrich(
        closed,
        lambda s: carts.join(s, "session_id", "left_semi"),
        lambda s: products.join(s, "session_id", "left_semi"),
        keep,
        f"{path}/checkpoint",
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("match_confidence").agg(F.count(F.lit(1)).alias("items"))


def stream_late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carts of a stream in which every fifth line of the last month's orders comes after its session has closed: the first run closes the
    sessions without them, the second corrects those that they belong to. The orders of the last day are still open."""
    carts, products = view(spark, sf_dir, "cart_lines"), view(spark, sf_dir, "viewed_products")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    lines = carts.join(orders, "session_id")
    (latest,) = orders.agg(F.max("ts")).first()
    late = (F.col("ts") > F.lit(latest) - F.expr("interval 30 days")) & (F.crc32(F.col("item_pos").cast("binary")) % 5 == 0)
    path = scratch_dir(spark, "late")

    def keep(enriched: DataFrame, batch_id: int) -> None:
        enriched.drop("enriched_at").write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    def arrived(sessions: DataFrame) -> DataFrame:
        return spark.read.schema(lines.schema).parquet(f"{path}/in").drop("ts").join(sessions, "session_id", "left_semi")

    for part in (~late, late):
        lines.filter(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{path}/in")
        closed = corrections.session_revisions(stream, "ts", gap="1 hour", delay="1 hour", lateness="45 days")
        corrections.stream_enrich_with_corrections(closed, arrived, lambda s: products.join(s, "session_id", "left_semi"), keep, f"{path}/checkpoint").awaitTermination()
    enriched = corrections.latest_revisions(spark.read.parquet(f"{path}/out").drop("batch"))
    return enriched.groupBy("match_confidence").agg(F.count(F.lit(1)).alias("items"))


QUERIES: dict[str, Query] = {
    "read_url_log": read_url_log,
    "read_url_log_faults": read_url_log_faults,
    "read_store_catalog": read_store_catalog,
    "read_golden_urls": read_golden_urls,
    "dim_store_by_id": dim_store_by_id,
    "dim_store_by_domain": dim_store_by_domain,
    "dim_store_name": dim_store_name,
    "dim_store_patterns": dim_store_patterns,
    "store_lookup": store_lookup,
    "registry_versions": registry_versions,
    "store_lookup_at": store_lookup_at,
    "url_log_analysis": url_log_analysis,
    "catalog_views": catalog_views,
    "catalog_enabled": catalog_enabled,
    "write_catalog_snapshot": write_catalog_snapshot,
    "write_report_tables": write_report_tables,
    "store_row_stats": _stats,
    "coverage_split": coverage_split,
    "coverage_totals": coverage_totals,
    "coverage_breakdown": coverage_breakdown,
    "catalog_coverage": catalog_coverage,
    "registry_issues": registry_issues,
    "url_log_gaps": url_log_gaps,
    "jsonld_product_filter": jsonld_product_filter,
    "jsonld_skus": jsonld_skus,
    "jsonld_product_summary": jsonld_product_summary,
    "asin_to_identifiers": _asins,
    "asin_summary": asin_summary,
    "image_manifest": image_manifest,
    "image_response_classify": image_response_classify,
    "image_retry_queue": image_retry_queue,
    "image_batch_summary": image_batch_summary,
    "stream_normalize_events": stream_normalize_events,
    "stream_product_views": stream_product_views,
    "stream_url_dedup": stream_url_dedup,
    "stream_batch_summary": stream_batch_summary,
    "stream_session_enrich": stream_session_enrich,
    "stream_late_lines": stream_late_lines,
}
