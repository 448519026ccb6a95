"""Helpers shared by the operators: reading tables, word counts, hot keys and seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.session import scratch_dir

#: Words are maximal runs of other characters than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: So many of the heaviest keys are looked up by broadcast; any other key then has less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def own_columns(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of the frame's, ignoring case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame's columns followed by the given ones; an input column of such a name gives way, whatever its case."""
    new = {c.lower() for c in columns}
    return df.select(*[df[c] for c in df.columns if c.lower() not in new], *[v.alias(k) for k, v in columns.items()])


def count_words(text: Column | str) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(column: Column | str, seed: int) -> Column:
    """60 bits of a seeded digest of a value, as long; null has a place of its own."""
    value = F.coalesce(F.concat(F.lit("="), F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value)), 1, 15), 16, 10).cast("long")


def parts_for(spark: SparkSession, rows: int, each: int = 100_000) -> int:
    """Tasks for so many rows: one for every ``each``, up to the session's number of shuffle partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """The frame as a table in the shared folder: what several steps read is worked out once, and a lost executor costs no more than its tasks.
    ``parts`` bounds the tasks that write, where the number of rows is known to be small."""
    path = scratch_dir(df.sparkSession, name)
    if parts is not None:
        df = df.coalesce(parts)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``written``, in buckets of ``key``: joins and groups by the key read it without a shuffle."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """Adds the columns of ``right``, which has one row per key, to each row of ``left``; ``how`` is inner or left.

    ``weight`` is the number of rows of ``left`` with the key, or in proportion to it. The HOT_KEYS heaviest keys are broadcast, which is
    a fixed number of rows; the rows of ``left`` that they serve don't meet by key but are dealt out by a hash of the row. So no task gets
    more than 1/HOT_KEYS of the rows for one key, and nothing is dropped. Rows with a null key match nothing. ``right`` is written down
    first, since it is read twice; ``parts`` as there.
    """
    right = written(right, "lookup", parts)
    values = [c for c in right.columns if c not in keys]
    hot = right.orderBy(F.col(weight).desc(), *keys).limit(HOT_KEYS)
    hot = hot.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.struct(*values, F.lit(1).alias("is_")).alias("h_"))
    on = [F.col(k) == F.col(f"h_{k}") for k in keys]
    left = left.join(F.broadcast(hot), on, "left").drop(*[f"h_{k}" for k in keys])
    spread = F.when(F.col("h_").isNotNull() | F.concat_ws("", *[F.col(k).isNull().cast("string") for k in keys]).contains("true"), F.xxhash64(*[c for c in left.columns if c != "h_"]))
    left = left.withColumn("s_", F.coalesce(spread, F.lit(0)))
    cold = right.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.struct(*values, F.lit(1).alias("is_")).alias("c_"), F.lit(0).cast("long").alias("c_s"))
    on = [F.col(k) == F.col(f"c_{k}") for k in keys] + [F.col("s_") == F.col("c_s")]
    # merged at any size: the plan, and what it moves, is the same for small and for large inputs
    both = left.join(cold.hint("merge"), on, "left").withColumn("v_", F.coalesce("h_", "c_"))
    if how == "inner":
        both = both.filter(F.col("v_").isNotNull())
    return both.select(*[c for c in left.columns if c not in ("h_", "s_")], *[F.col(f"v_.{c}").alias(c) for c in values])
