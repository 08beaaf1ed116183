"""Token counts as rollups that signed deltas maintain.

Totals by source, language and tokenizer version are sums, so an insert adds a
document's count, a delete subtracts it, and a revision subtracts the old count and adds
the new one. A batch is one folder of summed deltas that Spark commits as a whole; a batch
that is there is not written again, and a folder without its commit mark does not count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import as_bytes, fresh, rows_of, store
from pairlab.llm.packing import load_words

GROUPS = ["source", "lang", "tokenizer"]
ROLLUP = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, path: str, version: str, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(key, source, lang, text_hash, tokenizer, n_tokens) of whole texts; a null text is empty. A narrow pass.

    ``text_hash`` is the SHA-256 of the text. Null sources and languages stay null.
    """

    def run(batches):
        tokens = load_words(path)
        for batch in rows_of(batches, 128):
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            counts = [len(ids) // 4 for ids in tokens(texts)]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts, pa.int64())], [*names, "n_tokens"])

    slim = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.sha2(as_bytes(text), 256).alias("text_hash"),
        as_bytes(text).alias("text"),
    )
    fields = [f for f in slim.schema.fields if f.name != "text"]
    counted = slim.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("tokenizer", F.lit(version)).withColumnRenamed("key", key)


def _signed(rows: DataFrame, documents: int, tokens: Column) -> DataFrame:
    return rows.select(*GROUPS, F.lit(documents).cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"))


def inserts(rows: DataFrame, count: str = "n_tokens") -> DataFrame:
    """Deltas of new documents."""
    return _signed(rows, 1, F.coalesce(count, F.lit(0)))


def deletes(rows: DataFrame, count: str = "n_tokens") -> DataFrame:
    """Deltas of documents that go; ``count`` is what they were entered with."""
    return _signed(rows, -1, -F.coalesce(count, F.lit(0)))


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Deltas of documents whose count changes within their group."""
    return _signed(rows, 0, F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)))


class TokenLedger:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._":
            raise ValueError("a batch id holds letters, digits, '-', '_' and '.'")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self._folder(batch)}/_SUCCESS")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Sum the deltas and store them as one batch; false, and no work, if the batch is there.

        A run that fails leaves no commit mark, and the next try replaces what it left.
        A very frequent source is summed in every task before the shuffle.
        """
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*GROUPS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.coalesce(8).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._folder(batch))
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed ones of the named batches; groups without a document are left out."""
        found = [self._folder(b) for b in dict.fromkeys(batches) if self.committed(b)]
        rows = self.spark.read.schema(ROLLUP).parquet(*found) if found else self.spark.createDataFrame([], ROLLUP)
        sums = rows.groupBy(*GROUPS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def mark_copies(counted: DataFrame, key: str = "doc_id", mark: str = "is_copy") -> DataFrame:
    """The rows and whether a row with a smaller key has the same text; ``counted`` must be stored: it is read twice.

    A row is judged by its own key and text, so of a repeated key one row may be a copy and
    another not. Rows alike in key and text are no copies of each other; a row without a key
    is none. A very frequent text is combined in every task, and joins one row.
    """
    h, first = fresh(counted, "__h"), fresh(counted, "__first")
    firsts = store(counted.groupBy(F.col("text_hash").alias(h)).agg(F.min(f"`{key}`").alias(first)), "first-texts")
    later = F.coalesce(F.col(f"`{key}`") > F.col(first), F.lit(False))
    return counted.join(firsts, F.col("text_hash") == F.col(h), "left").withColumn(mark, later).drop(h, first)


def later_copies(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents whose text a document with a smaller key has; ``counted`` must be stored. Rows without a key stay."""
    mark = fresh(counted, "__copy")
    return mark_copies(counted, key, mark).filter(F.col(mark)).drop(mark)
