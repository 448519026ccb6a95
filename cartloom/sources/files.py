"""URL logs, store catalogs, golden URL sets and report tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.urls import settled

# Accepted column names of URL logs, in order of preference.
LOG_COLUMNS = {
    "store_id": ["storeid", "store_id", "store-id", "id", "merchant_id", "merchantid"],
    "store_name": ["storename", "store_name", "store-name", "name", "merchant_name", "merchantname", "domain"],
    "url_ids_csv": ["url_ids_csv", "url_ids", "ids", "extracted_ids"],
    "product_ids": ["product_ids", "productids", "product_id"],
    "url": ["url", "page_url"],
}
GOLDEN_SCHEMA = "name string, id variant, domain string, testCases array<struct<url: string, expectedSkus: array<string>, description: string>>"
CATALOG_SCHEMA = "`@rows` string, `@total` string, store array<struct<id: bigint, name: string, attributes: variant>>"


def _first_alias(columns: list[str], aliases: list[str]) -> str | None:
    by_name = {}
    for c in columns:
        by_name.setdefault(c.strip().lower(), c)
    return next((by_name[a] for a in aliases if a in by_name), None)


def read_url_log(spark: SparkSession, path: str, quoted_breaks: bool = True) -> DataFrame:
    """CSV URL log with a header; columns are found by their known names, short rows read as null, extra cells are ignored.

    Cells may hold quoted line breaks, so each file is read as a whole, as a stream; ``quoted_breaks=False`` lets Spark split the files of
    logs that have none.
    """
    raw = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        .option("quote", '"').option("escape", '"').option("multiLine", quoted_breaks).csv(path)
    )
    return resolve_log_columns(raw)


def read_url_log_checked(spark: SparkSession, path: str, quoted_breaks: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole rows of a CSV URL log, as ``read_url_log`` gives them, and the others: ``file``, ``fault`` and ``raw``, the row's text.

    A row is ``short`` or ``long`` if it has fewer or more cells than the header, and ``broken`` if quotes leave its cells unclear. Every row of
    the files is in one of the two tables; blank lines are no rows.
    """
    options = {"header": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": quoted_breaks}
    columns = spark.read.options(**options).csv(path).columns
    fault = next(n for i in range(len(columns) + 1) if (n := f"raw_row_{i}") not in columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, fault]])
    # without pruning, so that the cells of every row are counted whatever columns are read
    scan = spark.read.schema(schema).options(**options, enforceSchema=False, columnNameOfCorruptRecord=fault, columnPruning=False).csv(path)
    # and settled, since Spark doesn't read the faults alone
    scan = settled(scan.select("*", F.col("_metadata.file_name").alias(f"{fault}_file")), *columns, fault)
    raw = F.col(fault)
    # cells in quotes count as one whatever they hold
    cells = F.size(F.split(F.regexp_replace(raw, r'"(?:[^"]|"")*"', "q"), ",", -1))
    kind = F.when(F.regexp_replace(raw, r'"(?:[^"]|"")*"', "").contains('"'), F.lit("broken")).when(cells < len(columns), F.lit("short")).when(cells > len(columns), F.lit("long")).otherwise(F.lit("broken"))
    whole = resolve_log_columns(scan.filter(raw.isNull()).select(*[F.col(f"`{c}`") for c in columns]))
    faulty = scan.filter(raw.isNotNull()).select(F.col(f"{fault}_file").alias("file"), kind.alias("fault"), raw.alias("raw"))
    return whole, faulty


def resolve_log_columns(raw: DataFrame) -> DataFrame:
    """Renames the columns of a URL log to their canonical names; all other columns are kept."""
    found = {name: _first_alias(raw.columns, aliases) for name, aliases in LOG_COLUMNS.items()}
    if found["store_id"] is None:
        raise ValueError(f"no store id column among {raw.columns}")
    used = {c for c in found.values() if c}
    picked = [
        (F.col(f"`{column}`") if column else F.lit(None).cast("string")).alias(name) for name, column in found.items()
    ]
    return raw.select(*picked, *[F.col(f"`{c}`") for c in raw.columns if c not in used and c.lower() not in found])


def catalog_entries(stores: DataFrame, attributes: Column) -> DataFrame:
    """``id, name, product_search_enabled``, one row per id; attributes that are no object mean not enabled."""
    enabled = F.coalesce(F.try_variant_get(attributes, "$.productSearchEnabled", "boolean"), F.lit(False))
    # of a repeated id the last name counts and one enabled entry is enough
    return stores.select("id", "name", enabled.alias("enabled"), "pos").groupBy("id").agg(
        F.max_by("name", "pos").alias("name"), F.max("enabled").alias("product_search_enabled")
    )


def read_store_catalog(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Store catalog as the catalog service returns it: one JSON document per file, or per line, which lets Spark split large files."""
    doc = spark.read.schema(CATALOG_SCHEMA).option("multiLine", not one_per_line).json(path)
    # of a store listed twice the later entry counts: by file, then by place in the document
    doc = doc.select("store", F.col("_metadata.file_path").alias("file"))
    stores = doc.select("file", F.posexplode("store").alias("nth", "s")).select(F.struct("file", "nth").alias("pos"), "s.id", "s.name", "s.attributes")
    return catalog_entries(stores, F.col("attributes"))


def catalog_from_table(stores: DataFrame) -> DataFrame:
    """The same from a table with ``id, name`` and the attributes as JSON text."""
    return catalog_entries(stores.withColumn("pos", F.col("id")), F.try_parse_json("attributes"))


def catalog_enabled(catalog: DataFrame) -> DataFrame:
    return catalog.where("product_search_enabled").select("id", "name")


def catalog_lookup(requests: DataFrame, catalog: DataFrame, id_col: str = "store_id") -> DataFrame:
    """Name, name if enabled, and enabled flag per requested id; ids that do not start with a number find nothing."""
    number = F.regexp_extract(F.trim(id_col), r"^([+-]?\d+)", 1).try_cast("long")
    entries = catalog.select(F.col("id").alias("c_id"), F.col("name").alias("c_name"), "product_search_enabled")
    joined = requests.withColumn("numeric_id", number).join(entries, F.col("numeric_id") == F.col("c_id"), "left")
    enabled = F.coalesce("product_search_enabled", F.lit(False))
    return joined.select(
        *requests.columns,
        F.col("c_name").alias("name"),
        F.when(enabled, F.col("c_name")).alias("enabled_name"),
        enabled.alias("is_enabled"),
    )


def write_catalog_snapshot(catalog: DataFrame, path: str, snapshot_date: str) -> DataFrame:
    """Writes the catalog under its snapshot date, in place of an earlier one of that date, and returns the snapshot's totals."""
    writer = catalog.withColumn("snapshot_date", F.lit(snapshot_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("snapshot_date").parquet(path)
    written = catalog.sparkSession.read.parquet(path).where(F.col("snapshot_date") == snapshot_date)
    return written.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("total_stores"),
        F.count_if("product_search_enabled").alias("catalog_enabled"),
        F.count_if(~F.col("product_search_enabled")).alias("catalog_disabled"),
    )


def write_report(report: DataFrame, path: str, source: str, file_format: str = "parquet") -> None:
    """Writes a report table, marked with the source it was made from."""
    writer = report.withColumn("report_source", F.lit(source)).write.mode("overwrite")
    (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(path)


def read_golden_urls(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Golden sets, one JSON document per store (and file or line), as one row per test case."""
    doc = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", not one_per_line).json(path)
    return doc.select(
        F.col("name").alias("store_name"),
        F.try_variant_get("id", "$", "string").alias("store_id"),
        "domain",
        F.explode("testCases").alias("t"),
    ).select("store_name", "store_id", "domain", F.col("t.url").alias("url"), F.col("t.expectedSkus").alias("expected_skus"), F.col("t.description").alias("description"))
