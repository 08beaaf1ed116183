"""Queries on cleaning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text
from pairlab.plans.registry import register, rounded
from pairlab.session import read_table

_RAW_SQL = """raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value::VARCHAR WHEN 1 THEN ' ' || user_id || ' '
  WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 4 THEN NULL ELSE user_id || '.5' END AS raw FROM events)"""


def _raw(spark, sf):
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.col("value").cast("string"))
        .when(k == 1, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
        .when(k == 2, F.col("event_type"))
        .when(k == 3, F.lit(""))
        .when(k == 5, F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    )
    return read_table(spark, sf, "events").select("event_id", raw.alias("raw"))


@register(
    "lenient_cast",
    f"""WITH {_RAW_SQL} SELECT event_id,
      CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN try_cast(trim(raw) AS INTEGER) END AS as_int,
      try_cast(trim(raw) AS DOUBLE) AS as_double FROM raw""",
)
def lenient_cast(spark, sf):
    return _raw(spark, sf).select(
        "event_id",
        text.lenient_int(F.col("raw")).alias("as_int"),
        text.lenient_double(F.col("raw")).alias("as_double"),
    )


@register(
    "split_record",
    """WITH t AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN user_id || '-' || event_id
      WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'x-' || user_id WHEN 3 THEN user_id || '-x' ELSE '' END AS record FROM events)
    SELECT event_id, record, cast(CASE WHEN event_id % 5 IN (0, 3) THEN user_id END AS INTEGER) AS wins,
      cast(CASE WHEN event_id % 5 = 0 THEN event_id END AS INTEGER) AS losses FROM t""",
)
def split_record(spark, sf):
    k, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    record = (
        F.when(k == 0, F.concat_ws("-", user, F.col("event_id").cast("string")))
        .when(k == 1, user)
        .when(k == 2, F.concat(F.lit("x-"), user))
        .when(k == 3, F.concat(user, F.lit("-x")))
        .otherwise(F.lit(""))
    )
    df = read_table(spark, sf, "events").select("event_id", record.alias("record"))
    wins, losses = text.split_record(F.col("record"))
    return df.select("event_id", "record", wins.alias("wins"), losses.alias("losses"))


@register(
    "coalesce_pad",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS label,
      p_brand AS v0, CASE WHEN p_partkey % 4 >= 1 THEN p_type END AS v1,
      CASE WHEN p_partkey % 4 >= 2 THEN p_name END AS v2, CASE WHEN p_partkey % 4 >= 3 THEN 'extra' END AS v3,
      NULL::VARCHAR AS v4 FROM part""",
)
def coalesce_pad(spark, sf):
    part = read_table(spark, sf, "part")
    attribute = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(
        F.col("p_partkey") % 3 == 1, F.lit("")
    )
    cells = F.slice(
        F.array("p_brand", "p_type", "p_name", F.lit("extra")), 1, (F.col("p_partkey") % 4 + 1).cast("int")
    )
    padded = part.select(
        "p_partkey",
        text.first_non_empty(attribute, F.col("p_name")).alias("label"),
        text.pad_array(cells, 5).alias("v"),
    )
    return padded.select("p_partkey", "label", *[F.col("v")[i].alias(f"v{i}") for i in range(5)])


@register(
    "normalize_key",
    r"""WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id,
      md5(regexp_replace(replace(lower(regexp_replace(text, '^[\s\x{0085}\p{Z}]+|[\s\x{0085}\p{Z}]+$', '', 'g')), '.', ''), '[\s\x0B\x{0085}\p{Z}]+', ' ', 'g')) AS key_hash
      FROM t UNION ALL
      SELECT -1 - p_partkey, md5(lower(p_name)) FROM part""",
)
def normalize_key(spark, sf):
    """Keys of whole documents, and of part names with added case, periods and spaces."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"))
    noisy = F.concat(
        F.lit("\t "), F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(".  \n"))), F.lit(". ")
    )
    parts = read_table(spark, sf, "part").select(
        (-1 - F.col("p_partkey")).alias("doc_id"), F.rtrim(noisy).alias("name")
    )
    both = docs.unionByName(parts)
    return both.select("doc_id", F.md5(text.normalize_key(F.col("name"))).alias("key_hash"))


@register(
    "slugify",
    """SELECT p_partkey, lower(replace(p_name, ' ', '-')) || 's-' || lower(p_brand) AS slug FROM part""",
)
def slugify(spark, sf):
    part = read_table(spark, sf, "part")
    name = F.concat(F.upper("p_name"), F.lit("'S "), F.col("p_brand"))
    return part.select("p_partkey", text.slugify(name).alias("slug"))


@register(
    "period_label",
    """SELECT o_orderkey, (year(o_orderdate) - 1) || '-' || year(o_orderdate) AS label FROM orders""",
)
def period_label(spark, sf):
    return read_table(spark, sf, "orders").select(
        "o_orderkey", text.period_label(F.year("o_orderdate")).alias("label")
    )


@register(
    "json_array_explode",
    """SELECT p_partkey, cast(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'the "' || p_name || '"' END AS variant
    FROM part, (VALUES (0), (1), (2)) v(pos) WHERE pos <= p_partkey % 4 - 1""",
)
def json_array_explode(spark, sf):
    """Variants stored as JSON text and read back; an empty array gives no row."""
    part = read_table(spark, sf, "part")
    variants = F.slice(
        F.array("p_name", "p_brand", F.concat(F.lit('the "'), F.col("p_name"), F.lit('"'))),
        1,
        (F.col("p_partkey") % 4).cast("int"),
    )
    stored = part.select("p_partkey", text.encode_variants(variants).alias("alt_names"))
    return stored.select(
        "p_partkey", F.posexplode(text.decode_variants(F.col("alt_names"))).alias("pos", "variant")
    )


@register(
    "variant_union",
    """WITH v AS (SELECT p_name AS name, unnest([p_brand, p_type]) AS variant FROM part)
    SELECT name, string_agg(DISTINCT variant, '|' ORDER BY variant) AS variants, count(DISTINCT variant) AS n FROM v GROUP BY name""",
)
def variant_union(spark, sf):
    """Set union of two sources of variants per name."""
    part = read_table(spark, sf, "part")
    both = (
        part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("variant"))
        .union(part.select("p_name", "p_type"))
        .distinct()
    )
    return both.groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("variant")), "|").alias("variants"),
        F.count(F.lit(1)).alias("n"),
    )


@register(
    "json_props",
    """SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
def json_props(spark, sf):
    """Typed field of a JSON column, the scan half of nested-document reading."""
    parsed = F.from_json("props", "struct<k:int>")
    return rounded(read_table(spark, sf, "events").select("event_id", parsed["k"].alias("k")))
