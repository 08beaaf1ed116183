"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.bpe import bpe_round_trip
from pairlab.llm.common import int_crc, read_table, store
from pairlab.llm.importance import resample
from pairlab.llm.langid import identify_languages
from pairlab.llm.lm import not_held_out, score_texts
from pairlab.llm.merkle import as_hex, digest, encode_fields, fold_path, merkle_manifest, proof_digest
from pairlab.llm.metric_join import cosine_components
from pairlab.llm.mtree import top_inner_products
from pairlab.llm.oracles import ORACLES as SQL
from pairlab.llm.packing import pack_documents
from pairlab.llm.phrases import mine_phrases
from pairlab.llm.quality_rules import apply_rules
from pairlab.llm.sharding import assign_shards, number_slots, rendezvous
from pairlab.llm.simhash import simhash_components
from pairlab.llm.token_rollup import TokenLedger, count_tokens, deletes, inserts, mark_copies, revisions
from pairlab.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = dict(SQL)
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 24


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark, sf_dir):
    decoded = bpe_round_trip(read_table(spark, sf_dir, "documents"), BYTE_BPE)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_sharding(spark, sf_dir):
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    slim = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(data) + 8).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = assign_shards(slim, "doc_id", (1.0,) * SHARDS)
    placed = placed.withColumn("grown_shard", rendezvous(F.col("doc_id"), (1.0,) * (SHARDS + 1)))
    numbered = number_slots(placed, "doc_id", then=("size", "text_crc32"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op5_simhash(spark, sf_dir):
    return simhash_components(read_table(spark, sf_dir, "documents"))


@query
def op3_metric_join(spark, sf_dir):
    return cosine_components(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op2_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end=1)


@query
def op6_quality_rules(spark, sf_dir):
    ruled = apply_rules(read_table(spark, sf_dir, "documents"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op10_langid(spark, sf_dir):
    return identify_languages(read_table(spark, sf_dir, "documents"))


@query
def op7_lm_scoring(spark, sf_dir):
    return score_texts(read_table(spark, sf_dir, "documents"), not_held_out("doc_id"))


@query
def op8_importance(spark, sf_dir):
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op9_token_counts(spark, sf_dir):
    """All documents go in, later copies of a text come out, and the counts of the rest are revised to hold the end id."""
    counted = store(count_tokens(read_table(spark, sf_dir, "documents"), WORD_BPE, "word_bpe_49k"), "token-counts")
    ledger = TokenLedger(spark, scratch_path(spark, "ledger"))
    marked = store(mark_copies(counted), "marked")
    copies, kept = marked.filter("is_copy"), marked.filter("NOT is_copy")
    ledger.commit("insert", inserts(counted))
    ledger.commit("copies", deletes(copies))
    ledger.commit("end-id", revisions(kept.withColumn("revised", F.col("n_tokens") + 1), "n_tokens", "revised"))
    ledger.commit("copies", deletes(copies))  # a batch that comes twice counts once
    return ledger.totals(["insert", "copies", "end-id"])


@query
def op12_merkle(spark, sf_dir):
    """Every seventh document (by its key's CRC) is folded from a leaf with one added to ``n_chars``."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    added = digest(encode_fields(columns, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}))
    changed = F.when(int_crc(F.col("doc_id")) % 7 == 0, added)
    manifest = merkle_manifest(read_table(spark, sf_dir, "documents"), columns, keep={"changed": changed})
    folded = manifest.withColumn("folded_root", fold_path(F.coalesce(as_hex(F.col("changed")), "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_phrases(spark, sf_dir):
    return mine_phrases(read_table(spark, sf_dir, "documents"))


@query
def op11_topk(spark, sf_dir):
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024.0)
