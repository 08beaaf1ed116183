"""Pair features of contests as they arrive, from stored statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pairlab.operators.ranking import first_per_key
from pairlab.operators.state import load

BATCH = "served_batch"


def served(spark: SparkSession, target: str) -> DataFrame | None:
    """All rows served so far with the number of their batch, or None before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not any(f.isDirectory() for f in files.listStatus(path)):
        return None
    return spark.read.parquet(target)


def serve_features(
    spark: SparkSession,
    arrivals: str,
    schema: StructType,
    state_root: str,
    target: str,
    checkpoint: str,
    features: Callable[[DataFrame, DataFrame], DataFrame],
    key: str = "game_id",
    frame: str = "stats",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Serve the Parquet rows that arrived below ``arrivals`` since the last run, then end.

    ``features(batch, stats)`` joins a batch to the published statistics, read anew per
    batch: a version published between batches holds from the next one on. A batch is
    written to a folder of its own number, so one that runs again after a failure replaces
    what it had written. A key is served once: of repeats in one batch the first in order
    of all columns, and none that an earlier batch has served. Rows without a key are
    dropped; without new files nothing is written.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)

    def serve(batch: DataFrame, number: int) -> None:
        keyed = batch.filter(F.col(key).isNotNull())
        fresh = first_per_key(keyed, [key], [F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns]))])
        before = served(spark, target)
        if before is not None:
            fresh = fresh.join(before.filter(F.col(BATCH) != number).select(key), key, "left_anti")
        stats = load(spark, state_root).frames[frame]
        features(fresh, stats).write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    return (
        stream.writeStream.foreachBatch(serve)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
