"""The store registry over time: snapshots, the versions of each store's settings, and lookup as of an event's time.

A snapshot is a whole registry table that holds from a time on, until the next one. Versions keep only what changes from snapshot to snapshot: the
settings of a key (a store id or a domain) from a time on, or that the key is gone. An event meets the last version of its key that
isn't later than itself by a merge of events and versions in order of time, not by comparing it with every interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartloom.sources.registry import SETTINGS, dim_entries

#: Rows of one key that a task merges; keys with more are spread over several.
MERGED_ROWS = 1_000_000
_CONFIG = ["store_pos", "primary_id", "primary_domain", *SETTINGS]


def write_registry_snapshot(registry: DataFrame, path: str, valid_from: str) -> None:
    """Adds the registry that holds from a time on (``2024-01-31T12:00:00``, in the session's time zone); a snapshot of the same time is replaced."""
    registry.write.mode("overwrite").parquet(f"{path}/snapshot={valid_from.replace(':', '')}")


def read_registry_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots below a path, with ``valid_from``."""
    frames = spark.read.option("basePath", path).parquet(f"{path}/snapshot=*")
    text = F.regexp_replace(F.col("snapshot").cast("string"), r"T(\d\d)(\d\d)(\d\d)", "T$1:$2:$3")
    return frames.withColumn("valid_from", text.cast("timestamp")).drop("snapshot")


def registry_versions(snapshots: DataFrame) -> DataFrame:
    """``kind`` (id, domain), ``key``, ``valid_from``, ``valid_to`` (null: still holds) and ``config``, the settings or null where the key is gone.

    Snapshots of unchanged settings make no version. A key's last entry in a snapshot wins, as in the registry's own lookup.
    """
    entries = dim_entries(snapshots)
    config = F.struct(F.col("pos").alias("store_pos"), F.col("id").alias("primary_id"), F.col("domain").alias("primary_domain"), *SETTINGS)
    by_kind = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"entry_{kind}").alias("key")) for kind in ("id", "domain")]))
    keyed = entries.select("valid_from", config.alias("config"), "pos", "alias_pos", by_kind).filter(F.col("key").isNotNull())
    last = keyed.groupBy("kind", "key", "valid_from").agg(F.max_by("config", F.struct("pos", "alias_pos")).alias("config"))
    # the times of all snapshots, one row each, tell where a key's presence ends
    times = snapshots.select("valid_from").distinct()
    following = times.select(F.col("valid_from").alias("time"), F.lead("valid_from").over(Window.orderBy("valid_from")).alias("next"))
    present = last.join(following, F.col("valid_from") == F.col("time"))
    of_key = Window.partitionBy("kind", "key").orderBy("valid_from")
    seen = present.withColumn("again", F.lead("valid_from").over(of_key))
    gone = seen.filter("next IS NOT NULL AND NOT next <=> again").select("kind", "key", F.col("next").alias("valid_from"), F.lit(None).cast(last.schema["config"].dataType).alias("config"))
    both = last.select("kind", "key", "valid_from", "config").unionByName(gone)
    digest = F.coalesce(F.sha2(F.to_json("config"), 256), F.lit(""))
    changed = both.withColumn("before", F.lag(digest).over(of_key)).filter(~F.col("before").eqNullSafe(digest)).drop("before")
    return changed.select("kind", "key", "valid_from", F.lead("valid_from").over(of_key).alias("valid_to"), "config")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, value: str) -> DataFrame:
    """The rows of ``left`` with ``value`` of the last row of ``right`` that has the same keys and isn't later; null where there is none.

    Both sides are merged by key and time and the last value is carried forward. Keys with more than ``MERGED_ROWS`` rows are dealt out over
    several tasks, each with a copy of that key's rows of ``right``; rows with a null key match nothing and are dealt out as well.
    """
    numbered = left.select(F.struct(*left.columns).alias("row"), *keys, F.col(time).alias("t"))
    hot = numbered.dropna(subset=list(keys)).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / MERGED_ROWS).cast("int").alias("parts")).filter("parts > 1")
    hot = hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys], "parts")

    def with_parts(df: DataFrame) -> DataFrame:
        on: list[Column] = [F.col(k) == F.col(f"hot_{k}") for k in keys]
        return df.join(hot, on, "left").drop(*[f"hot_{k}" for k in keys]).withColumn("parts", F.coalesce("parts", F.lit(1)))

    missing = F.concat(*[F.col(k).isNull().cast("string") for k in keys]).contains("true")
    deal = F.pmod(F.xxhash64(F.to_json("row")), F.when(missing, F.lit(1 << 20)).otherwise(F.col("parts"))).cast("int")
    events = with_parts(numbered).select("row", *keys, "t", F.lit(1).alias("side"), deal.alias("part"))
    versions = with_parts(right.select(*keys, F.col(right_time).alias("t"), F.struct(F.col(value).alias("value")).alias("held")))
    versions = versions.dropna(subset=list(keys)).select(*keys, "t", F.lit(0).alias("side"), "held", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    order = Window.partitionBy(*keys, "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = events.unionByName(versions, allowMissingColumns=True).withColumn("held", F.last("held", ignorenulls=True).over(order))
    return merged.filter("side = 1").select("row.*", F.when(F.col("t").isNotNull() & ~missing, F.col("held.value")).alias(value))


def store_lookup_at(df: DataFrame, versions: DataFrame, time_col: str, id_col: str = "store_id", domain_col: str = "domain") -> DataFrame:
    """Adds the settings that the row's store had at the row's time: by id where the row has one, otherwise by domain, never both."""
    given = F.nullif(F.col(id_col), F.lit(""))
    keyed = df.withColumn("kind", F.when(given.isNotNull(), F.lit("id")).otherwise(F.lit("domain"))).withColumn("key", F.coalesce(given, F.col(domain_col)))
    found = asof_join(keyed, versions, ["kind", "key"], time_col, "valid_from", "config")
    return found.select(*df.columns, *[F.col(f"config.{c}").alias(c) for c in _CONFIG])
