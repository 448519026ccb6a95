"""Store registry as dimension tables.

A registry table has one row per store:
``pos, id, domain, aliases array<struct<id,domain>>, path_patterns array<string>, query_patterns array<string>,
rewrite_find, rewrite_to``. It may be the built-in one or any table of that shape; the dimensions below are ordinary
aggregates of it, so a registry of any size works. Joins against them carry no broadcast hint: Spark broadcasts them
when their size is below its threshold and shuffles otherwise.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.sources.store_rules import STORES

REGISTRY_SCHEMA = (
    "pos bigint, id string, domain string, aliases array<struct<id: string, domain: string>>, "
    "path_patterns array<string>, query_patterns array<string>, rewrite_find string, rewrite_to string"
)

_ARROW_SCHEMA = pa.schema(
    [
        ("pos", pa.int64()),
        ("id", pa.string()),
        ("domain", pa.string()),
        ("aliases", pa.list_(pa.struct([("id", pa.string()), ("domain", pa.string())]))),
        ("path_patterns", pa.list_(pa.string())),
        ("query_patterns", pa.list_(pa.string())),
        ("rewrite_find", pa.string()),
        ("rewrite_to", pa.string()),
    ]
)


def registry_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Registry table from ``(id, domain, path patterns, query patterns, options)`` rows, in lookup order."""
    records = [
        {
            "pos": pos,
            "id": store_id,
            "domain": domain,
            "aliases": [{"id": a, "domain": d} for a, d in options.get("aliases", [])],
            "path_patterns": list(paths),
            "query_patterns": list(queries),
            "rewrite_find": options.get("rewrite", (None, None))[0],
            "rewrite_to": options.get("rewrite", (None, None))[1],
        }
        for pos, (store_id, domain, paths, queries, options) in enumerate(rows)
    ]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=_ARROW_SCHEMA))


def builtin_registry(spark: SparkSession) -> DataFrame:
    return registry_from_rows(spark, STORES)


def dim_entries(registry: DataFrame) -> DataFrame:
    """One row per primary or alias entry, with its place in the lookup order."""
    primary = registry.select("*", F.lit(-1).alias("alias_pos"), F.col("id").alias("entry_id"), F.col("domain").alias("entry_domain"))
    alias = registry.select("*", F.posexplode("aliases").alias("alias_pos", "a")).select(
        *registry.columns, "alias_pos", F.col("a.id").alias("entry_id"), F.col("a.domain").alias("entry_domain")
    )
    return primary.unionByName(alias)


def _config() -> Column:
    return F.struct(
        F.col("pos").alias("store_pos"),
        F.col("id").alias("primary_id"),
        F.col("domain").alias("primary_domain"),
        "path_patterns",
        "query_patterns",
        "rewrite_find",
        "rewrite_to",
    )


def _last_entry(entries: DataFrame, key: str, name: str) -> DataFrame:
    return (
        entries.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(name))
        .agg(F.max_by(_config(), F.struct("pos", "alias_pos")).alias("c"))
        .select(name, "c.*")
    )


def dim_store_by_id(registry: DataFrame) -> DataFrame:
    """Store settings per store id; alias ids lead to their store and the last entry of a repeated id wins."""
    return _last_entry(dim_entries(registry), "entry_id", "store_id")


def dim_store_by_domain(registry: DataFrame) -> DataFrame:
    """Store settings per domain, alias domains and stores without an id included."""
    return _last_entry(dim_entries(registry), "entry_domain", "store_domain")


def dim_store_name(registry: DataFrame) -> DataFrame:
    """Domain to store id; an alias domain keeps the id of the alias."""
    return (
        dim_entries(registry)
        .where(F.col("entry_id").isNotNull())
        .groupBy(F.col("entry_domain").alias("store_domain"))
        .agg(F.max_by("entry_id", F.struct("pos", "alias_pos")).alias("store_id"))
    )


def dim_store_patterns(registry: DataFrame) -> DataFrame:
    """One row per URL pattern of a store that has an id, in the order the patterns are tried."""
    with_id = registry.where(F.col("id").isNotNull())
    last = with_id.groupBy("id").agg(
        F.max_by(F.struct("path_patterns", "query_patterns"), "pos").alias("p")
    )
    path = last.select("id", F.lit("pathname").alias("part"), F.posexplode("p.path_patterns").alias("ordinal", "regex"))
    query = last.select("id", F.lit("search").alias("part"), F.posexplode("p.query_patterns").alias("ordinal", "regex"))
    return path.unionByName(query).withColumnRenamed("id", "store_id")


#: What a store's settings tell about its URLs.
SETTINGS = ["path_patterns", "query_patterns", "rewrite_find", "rewrite_to"]
#: Entries of a registry that may go into an expression; a larger one is joined.
MOST_ENTRIES = 2000


def settings_by_key(registry: DataFrame) -> tuple[Column, Column] | None:
    """The stores' settings by id and by domain as constant maps; None for a registry of more than ``MOST_ENTRIES`` entries."""
    by_id = dim_store_by_id(registry).select(F.lit(0).alias("map"), F.col("store_id").alias("key"), *SETTINGS)
    by_domain = dim_store_by_domain(registry).select(F.lit(1), "store_domain", *SETTINGS)
    rows = by_id.union(by_domain).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        return None
    # one literal each, read once when the query is planned
    shape = f"map<string, struct<{SETTINGS[0]}: array<string>, {SETTINGS[1]}: array<string>, {SETTINGS[2]}: string, {SETTINGS[3]}: string>>"
    texts = [json.dumps({r.key: {n: r[n] for n in SETTINGS} for r in rows if r["map"] == i}) for i in (0, 1)]
    return tuple(F.from_json(F.lit(t), shape) for t in texts)


def store_lookup(df: DataFrame, registry: DataFrame, id_col: str = "store_id", domain_col: str = "domain") -> DataFrame:
    """Adds the settings of the row's store: by id where the row has one, otherwise by domain, never both."""
    by_id = dim_store_by_id(registry)
    by_domain = dim_store_by_domain(registry)
    settings = [c for c in by_id.columns if c != "store_id"]
    ids = by_id.select(F.col("store_id").alias("k_id"), *[F.col(c).alias(f"i_{c}") for c in settings])
    domains = by_domain.select(F.col("store_domain").alias("k_domain"), *[F.col(c).alias(f"d_{c}") for c in settings])
    given_id = F.nullif(F.col(id_col), F.lit(""))
    joined = (
        df.withColumn("lookup_id", given_id)
        .withColumn("lookup_domain", F.when(given_id.isNull(), F.col(domain_col)))
        .join(ids, F.col("lookup_id") == F.col("k_id"), "left")
        .join(domains, F.col("lookup_domain") == F.col("k_domain"), "left")
    )
    picked = [F.when(F.col("lookup_id").isNotNull(), F.col(f"i_{c}")).otherwise(F.col(f"d_{c}")).alias(c) for c in settings]
    return joined.select(*df.columns, *picked)
