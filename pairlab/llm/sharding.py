"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair draws a number in (0, 1) from a digest; the shard with the
least ``-ln(draw) / weight`` takes the record. A shard's chance is its share of the
weights, and a further shard takes records only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import fresh

#: Hexadecimal digits of the digest that make the draw: 48 bits, exact as a double.
DRAW_DIGITS = 12
#: Records of one shard are counted in 16 ** 3 slices of the key's digest.
SLICE_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    value = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint").cast("double")
    return (value + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that takes a key; ties go to the lower number, a null key counts as the empty text."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.log(_draw(text, s)) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(
    records: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 24, shard: str = "shard"
) -> DataFrame:
    """All columns of the records and their shard. A narrow pass; repeated keys share a shard."""
    return records.withColumn(shard, rendezvous(F.col(f"`{key}`"), weights))


def number_slots(
    records: DataFrame, key: str = "doc_id", shard: str = "shard", slot: str = "slot", then: Sequence[str] = ()
) -> DataFrame:
    """Number the records of each shard from 0 without a gap.

    The order is (slice, key, ``then``), where the slice is made of the first digits
    of the key's digest. Slices are counted first and their sums give each slice its
    first number, so no task sorts a whole shard. Rows alike in key and ``then`` get
    neighbouring numbers. The count has at most 4096 rows per shard.
    """
    part, rank, first, n = (fresh(records, x) for x in ("__slice", "__rank", "__first", "__n"))
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    sliced = records.withColumn(part, F.substring(F.md5(text.cast("binary")), 1, SLICE_DIGITS))
    counts = sliced.groupBy(shard, part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(shard, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(shard, part).orderBy(key, *then)
    return (
        sliced.withColumn(rank, F.row_number().over(within))
        .join(firsts, [shard, part])
        .withColumn(slot, F.col(first) + F.col(rank) - 1)
        .drop(first, rank, part)
    )


def write_shards(records: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 8) -> None:
    """Write the records below ``path``, one folder per shard; rows of a shard are dealt over several tasks."""
    dealt = records.withColumn("__file", F.pmod(F.xxhash64(*records.columns), F.lit(files_per_shard)))
    dealt.repartition(F.col(shard), F.col("__file")).drop("__file").write.partitionBy(shard).parquet(path)
