"""Incremental ingestion: only files not seen before are read.

The checkpoint of the streaming query is the manifest of finished files, so a
run that is interrupted goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairlab.sources.json_docs import flatten_contests


def ingest_new_contests(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Flatten the scoreboard documents that arrived below ``source`` since the last run.

    Each file is one document. The query reads what is there now and ends.
    """
    docs = (
        spark.readStream.option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .text(source)
    )
    return (
        flatten_contests(docs, "value")
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
