"""Views over the driver tables that stand in for the contest data.

Entities are suppliers, a period is a year, a contest is an order whose first two
suppliers meet. Money and rates are summed as decimals: the sums are exact, so a
retried task cannot change a result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.functions.probability import logistic
from pairlab.operators.assemble import pair_dim_join, stat_variants
from pairlab.operators.features import (
    Composite,
    build_pair_features,
    seed_columns,
    stat_columns,
    vector_to_long,
    with_rounds,
)
from pairlab.operators.pairs import orient_pairs
from pairlab.session import read_table

MEASURES = ("qty", "price", "disc", "tax", "ret")
META = ("entity_id", "period", "entity_name", "n_facts")
ROUND_TEXTS = (
    "First Four", "FIRST ROUND", "Second Round", "Third Round", "SWEET 16&#174;",
    "Sweet Sixteen", "Elite Eight", "elite 8 ", "FINAL FOUR®", "National Championship",
    "3", "bogus", " 2 ", "7.9",
)
REGIONS = ("East", "West", "South", "Midwest")
COMPOSITES = (
    Composite("margin_gap", {"price_season": 1.0, "disc_season": -1.0}),
    Composite("volume_index", {"qty_season": 1.0}, {"tax_season": 0.5, "ret_season": -0.3}),
    Composite("recent_index", {"qty_last3": 1.0}, {"tax_last3": 0.5, "absent_last3": 0.3}),
)
# Weights of the deterministic base predictors: seed difference, price, quantity.
BASE_WEIGHTS = ((-0.08, 0.00002, 0.01), (-0.03, 0.00005, 0.02), (-0.12, 0.0, 0.05), (0.0, 0.00008, -0.02))
SUPPLIER_SEEDS = 16
# A supplier is in some forty contests of a year, so eight copies of its statistics are less than theirs.
BLOCKS = 4


def view(build):
    """Define a view once per session: its plan is kept, never its rows."""

    @wraps(build)
    def lookup(spark: SparkSession, sf: str, *args):
        plans = spark.__dict__.setdefault("_pairlab_views", {})
        key = (build.__name__, sf, args)
        if key not in plans:
            plans[key] = build(spark, sf, *args)
        return plans[key]

    return lookup


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


@view
def facts(spark: SparkSession, sf: str) -> DataFrame:
    line = read_table(spark, sf, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("entity_id"),
        F.year("l_shipdate").alias("period"),
        "l_linestatus",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        _money("l_quantity").alias("qty"),
        _money("l_extendedprice").alias("price"),
        _money("l_discount").alias("disc"),
        _money("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("decimal(18,2)").alias("ret"),
    )


@view
def supplier_names(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name")
    )


@view
def entity_stats(spark: SparkSession, sf: str) -> DataFrame:
    recency = [
        F.desc(c)
        for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price", "qty", "disc", "tax", "ret")
    ]
    stats = stat_variants(
        facts(spark, sf),
        ["entity_id"],
        "period",
        MEASURES,
        recency,
        F.col("l_linestatus") == "O",
        F.col("l_linestatus") == "F",
    )
    return stats.join(supplier_names(spark, sf), "entity_id", "left")


@view
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Name, seed and season means per (entity, period).

    Seeds run from 1 to 16 by yearly revenue within blocks of sixteen suppliers;
    every seventeenth supplier has none.
    """
    yearly = (
        facts(spark, sf)
        .groupBy("entity_id", "period")
        .agg(F.sum("price").alias("revenue"), F.sum("qty").alias("_qty"), F.count(F.lit(1)).alias("_n"))
    )
    block = F.floor(F.col("entity_id") / SUPPLIER_SEEDS)
    window = Window.partitionBy("period", block).orderBy(F.desc("revenue"), "entity_id")
    return yearly.select(
        "entity_id",
        "period",
        "revenue",
        F.when(F.col("entity_id") % 17 != 0, F.row_number().over(window)).alias("seed"),
        (F.col("revenue").cast("double") / F.col("_n")).alias("price"),
        (F.col("_qty").cast("double") / F.col("_n")).alias("qty"),
    ).join(supplier_names(spark, sf).withColumnRenamed("entity_name", "name"), "entity_id", "left")


@view
def games(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Away and home side of every order with at least two suppliers.

    A contest is defined as the first two suppliers of an order, by the line on which
    they first appear; it stands for the pair table that a user brings, and lines of
    further suppliers belong to no contest.
    Each side takes name, seed and the ``extra`` profile columns in one join.
    """
    line = read_table(spark, sf, "lineitem")
    sides = line.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("first_line"), F.sum(_money("l_extendedprice")).alias("score")
    )
    window = Window.partitionBy("l_orderkey").orderBy("first_line", "l_suppkey")
    two = (
        sides.withColumn("rn", F.row_number().over(window))
        .filter("rn <= 2")
        .groupBy("l_orderkey")
        .agg(
            *[
                F.max(F.when(F.col("rn") == i, F.col(c))).alias(f"{side}_{name}")
                for i, side in ((1, "away"), (2, "home"))
                for c, name in (("l_suppkey", "id"), ("score", "points"))
            ]
        )
        .filter("home_id is not null")
    )
    orders = read_table(spark, sf, "orders")
    key = F.col("l_orderkey")

    def pick(texts: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))

    flags = {
        "away_winner": F.col("away_points") > F.col("home_points"),
        "home_winner": F.col("home_points") > F.col("away_points"),
    }
    dated = two.join(orders, key == F.col("o_orderkey")).select(
        key.alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").alias("period"),
        "away_id",
        "home_id",
        F.col("away_points").cast("double").alias("away_score"),
        F.col("home_points").cast("double").alias("home_score"),
        *[F.when(key % 13 != 0, cond).alias(name) for name, cond in flags.items()],
        pick(ROUND_TEXTS).alias("bracket_round"),
        pick(REGIONS).alias("bracket_region"),
    )
    dim = profiles(spark, sf).select("entity_id", "period", "name", "seed", *extra)
    return pair_dim_join(dated, dim, "entity_id", "period", {"away": "away_id", "home": "home_id"}, blocks=BLOCKS)


PAIR_KEEP = ("game_id", "period", "game_date", "bracket_round", "bracket_region")


@view
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return orient_pairs(games(spark, sf), keep=PAIR_KEEP)


@view
def joined_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pair_dim_join(
        pairs(spark, sf),
        entity_stats(spark, sf),
        "entity_id",
        "period",
        {"a": "a_id", "b": "b_id"},
        drop=("entity_name", "n_facts"),
        blocks=BLOCKS,
    )


def stat_names(spark: SparkSession, sf: str) -> list[str]:
    return stat_columns(entity_stats(spark, sf), META)


@view
def pair_features(spark: SparkSession, sf: str, denominator: str = "clip") -> DataFrame:
    return build_pair_features(
        joined_pairs(spark, sf), stat_names(spark, sf), COMPOSITES, denominator=denominator
    )


@view
def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with four deterministic base predictions."""
    attributes = ("id", "name", "seed", "score", "price", "qty")
    oriented = orient_pairs(games(spark, sf, ("price", "qty")), attributes, PAIR_KEEP)
    gap, price, qty = [
        F.coalesce(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(0.0)) for c in ("seed", "price", "qty")
    ]
    preds = [
        F.round(logistic(F.lit(w[0]) * gap + F.lit(w[1]) * price + F.lit(w[2]) * qty), 6)
        for w in BASE_WEIGHTS
    ]
    return with_rounds(oriented).select(
        "game_id", "period", "bracket_region", "a_name", "b_name", "a_seed", "b_seed", "winner",
        "round_number", "round_group",
        *seed_columns(F.col("a_seed"), F.col("b_seed")),
        *[p.alias(f"p{i}") for i, p in enumerate(preds)],
    )


def with_ensemble(df: DataFrame) -> DataFrame:
    """Adds ``preds`` (array) and ``prob``, their rounded mean."""
    total = F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3")
    return df.withColumn("preds", F.array("p0", "p1", "p2", "p3")).withColumn(
        "prob", F.round(total / F.lit(4.0), 9)
    )


def tolerant_preds(df: DataFrame) -> DataFrame:
    """Base predictions with one model missing in rounds before the third."""
    return df.withColumn("p2", F.when(F.col("round_number") >= 3, F.col("p2")))


@view
def embedding_features(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, y, feature, pos, x) of the embeddings; the label is whether it is below 5."""
    df = read_table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return vector_to_long(df, "embedding", ["vec_id", "y"])


@view
def document_features(spark: SparkSession, sf: str) -> DataFrame:
    """Shape features of the labelled documents, read from the whole text."""
    docs = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    text = F.col("text")
    n = F.length(text)
    words = F.regexp_count(text, F.lit(r"[^ \n]+"))
    return docs.select(
        "doc_id",
        F.col("quality").alias("y"),
        n.cast("double").alias("chars"),
        words.cast("double").alias("words"),
        F.regexp_count(text, F.lit("\n")).cast("double").alias("lines"),
        F.regexp_count(text, F.lit("[0-9]")).cast("double").alias("digits"),
        F.regexp_count(text, F.lit("[.,;:!?]")).cast("double").alias("marks"),
        F.try_divide(F.regexp_count(text, F.lit("[A-Z]")).cast("double"), n).alias("upper_share"),
    )
