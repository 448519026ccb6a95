"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cartloom", master: str | None = None, cores: int | None = None) -> SparkSession:
    """Session for tests and local benches; a cluster passes its own session to every job instead."""
    cores = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.appName(app_name)
        .master(master or f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CARTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    A local session runs in one process, so there a temporary folder serves where the setting is missing; a cluster session without the
    setting is refused, since its executors would write to disks that the others cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cartloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_settings(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of its own with the caller's settings and some more; the caller's session stays as it is."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in settings.items():
        own.conf.set(f"spark.sql.{name.replace('__', '.')}", value)
    return own


#: A bucket of a table that ``bucketed`` writes has about so many rows, where the session's number of shuffle partitions would leave more.
BUCKET_ROWS = 150_000


def bucketed(df: DataFrame, key: str, name: str, rows: int = 0) -> DataFrame:
    """The frame, of about so many rows, as a table in the shared folder with a file for each bucket of ``key``.

    It is read by a session in which tables that meet by the key, or by the key and further columns, need no shuffle. The shuffle files
    that writing needed go as soon as it is written.
    """
    own = with_settings(df.sparkSession, requireAllClusterKeysForCoPartition="false")
    path = scratch_dir(own, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    parts = max(int(own.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    dealt = tidy(df).repartition(parts, key)
    dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table)
    return own.table(table)


def tidy(df: DataFrame) -> DataFrame:
    """The frame in a session that removes shuffle files at the end of each job: for what is run once."""
    own = with_settings(df.sparkSession, classic__shuffleDependency__fileCleanup__enabled="true")
    return DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)
