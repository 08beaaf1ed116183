"""A maintained mapping of names to entities: a name goes through the cascade once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators.resolve import attach_ids, resolve_cascade
from pairlab.session import cut_lineage

BATCH = "map_batch"
_SCHEMA = f"name string, entity_id bigint, method string, score double, {BATCH} string"


class NameMap:
    """(name, entity_id, method, score) below one root, one folder per batch.

    One writer at a time. Names that resolved to nothing are kept too and are not tried
    again; after a change of the index or the overrides that should reach old names,
    start a map below another root.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def entries(self, besides: str | None = None) -> DataFrame:
        """All mapped names; without those of one batch if it is named. Empty before the first batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        kept = [f for f in folders if f.startswith(f"{BATCH}=") and f != f"{BATCH}={besides}"]
        if not kept:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", self.root).parquet(*[f"{self.root}/{f}" for f in kept])

    def extend(
        self,
        batch: str,
        names: DataFrame,
        index: DataFrame,
        overrides: DataFrame,
        name: str = "name",
        cutoff: float | None = 80.0,
        scorer: str = "weighted",
    ) -> int:
        """Resolve the names that no other batch holds; returns how many these were.

        A batch that is given again replaces what it had written, so a failed one is
        simply run anew. Null names are left out. The join with the known names reads
        their name column only.
        """
        if not re.fullmatch(r"[A-Za-z][\w-]*", batch):
            raise ValueError(f"{batch!r} can't name a batch")
        distinct = names.select(F.col(f"`{name}`").alias("name")).filter(F.col("name").isNotNull()).distinct()
        # Stored, so that the two sides of the cascade don't build the source of the names again.
        fresh = cut_lineage(distinct.join(self.entries(besides=batch).select("name"), "name", "left_anti"), "fresh")
        folder = f"{self.root}/{BATCH}={batch}"
        resolve_cascade(fresh, index, overrides, cutoff=cutoff, scorer=scorer).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder).count()

    def attach(self, df: DataFrame, sides: dict[str, str]) -> DataFrame:
        """``{'away_name': 'away_id'}``: the ids of all sides; names not mapped yet get none."""
        return attach_ids(df, self.entries(), sides)
