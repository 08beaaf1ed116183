"""Parquet discovery, drift-tolerant union, request grids, sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_periods(
    spark: SparkSession, root: str, period: str = "period", pattern: str = r"/(\d{4})(?:\.parquet|/[^/]+\.parquet)$"
) -> DataFrame:
    """Read every per-period file below ``root`` and tag rows from the file path.

    Covers ``root/2019.parquet`` and ``root/2019/stat.parquet``. A column of that
    name which is already in the files is kept as it is.
    """
    df = (
        spark.read.option("recursiveFileLookup", "true")
        .option("mergeSchema", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
    )
    if period in df.columns:
        return df
    return df.withColumn(
        period, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int")
    )


def scan_partitioned(spark: SparkSession, root: str) -> DataFrame:
    """Hive-style layout: the period is a partition column, so filters prune files."""
    return spark.read.option("mergeSchema", "true").option("basePath", root).parquet(root)


def with_period(df: DataFrame, value: int, period: str = "period") -> DataFrame:
    """Constant period column, only where the frame has none."""
    return df if period in df.columns else df.withColumn(period, F.lit(value))


def union_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name: absent columns are NULL, numbers widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_names(frames: Sequence[DataFrame], name: str) -> DataFrame:
    """Distinct names over all sources; each source is reduced before the union."""
    parts = [df.select(F.col(name).alias("name")).distinct() for df in frames]
    return reduce(DataFrame.union, parts).distinct()


def date_grid(years: DataFrame, spans: Sequence[tuple[str, str]], year: str = "year") -> DataFrame:
    """One row per year and calendar day of each ``('MM-dd', 'MM-dd')`` span."""
    days = F.flatten(
        F.array(
            *[
                F.sequence(
                    F.to_date(F.concat_ws("-", F.col(year).cast("string"), F.lit(lo))),
                    F.to_date(F.concat_ws("-", F.col(year).cast("string"), F.lit(hi))),
                )
                for lo, hi in spans
            ]
        )
    )
    return years.select(F.col(year), F.explode(days).alias("day"))


def request_grid(years: DataFrame, items: Sequence[str], cutoffs: DataFrame, year: str = "year") -> DataFrame:
    """Years × items with the year's cut-off; years without one are skipped."""
    return years.join(cutoffs, year, "inner").select(
        year, F.explode(F.array(*[F.lit(i) for i in items])).alias("item"), "cutoff"
    )


def incremental_todo(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units of the grid that the manifest of finished units does not hold."""
    return grid.join(done.select(*keys), list(keys), "left_anti")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite. No shuffle is added: each task writes the values it holds, so a
    value with most of the rows is written by many tasks."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON document per row, NULL fields kept."""
    packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(packed.alias(column))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
