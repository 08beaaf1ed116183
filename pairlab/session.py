"""Session helpers: table access, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_fallback_dir: str | None = None


def build_session(cpus: int | str = "*", app: str = "pairlab", **conf: str) -> SparkSession:
    """Local session for tests and benches; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_methods(spark: SparkSession) -> None:
    """Let Spark fuse operators only into methods that the JVM compiles, unless the session says otherwise.

    Java interprets methods of more than 8000 bytes for ever. Projections of many columns
    pass that when they are fused and take many times as long; unfused they are split.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, "65535") == "65535":
        spark.conf.set(limit, "8000")


def keep_partitions(spark: SparkSession) -> None:
    """Let joins keep frames that lie together by some of their keys, instead of dealing both anew by all.

    It changes no result and holds for the session from then on.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session (whose executor is the driver) gets a temporary folder; any other one
    fails, since executors would not see each other's files.
    """
    global _fallback_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="pairlab-")
    return _fallback_dir


def session_root(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/pairlab-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's part of the shared folder."""
    return f"{session_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all stages this application has stored; frames built on them can't be read afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(session_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def cut_lineage(df: DataFrame, label: str = "stage", by: Sequence[str] = (), row_group: int = 128 << 20) -> DataFrame:
    """Write the frame to the shared folder and go on from the stored copy.

    Runs a job when called. The copy survives the loss of any executor, is read column
    by column, and carries true sizes for the joins that follow. ``by`` names columns
    that become folders, so that a filter on them reads only those. Tasks that write or
    read the copy hold some ``row_group`` bytes of it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", row_group).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
