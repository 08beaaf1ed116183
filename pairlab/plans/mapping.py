"""Queries on the whole cascade, fuzzy tier included, over names that differ in letters.

An entity is named by two words of letters made from its key's digest; contests and
statistics spell the names in several ways, with letters lost or added.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlab.operators.assemble import drop_unresolved
from pairlab.operators.mapping import NameMap
from pairlab.operators.ranking import first_per_key
from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_GAMES, WITH_STATS, r
from pairlab.plans.registry import register, rounded
from pairlab.plans.resolving import _fuzzy_sql
from pairlab.session import cut_lineage, read_table, scratch_path

HEX, LETTERS = "0123456789abcdef", "bcdfghklmnprstvw"


def entity_name(key: Column) -> Column:
    letters = F.translate(F.md5(key.cast("string")), HEX, LETTERS)
    return F.concat(F.substring(letters, 1, 8), F.lit(" "), F.substring(letters, 9, 6))


def spelled(key: Column, turn: Column) -> Column:
    """One of six spellings, two of them with a letter lost or added, one that is nobody's."""
    name, style = entity_name(key), (turn + key) % 6
    at = (F.lit(2) + turn % 6).cast("int")
    head, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name))
    return (
        F.when((style == 0) & (key % 10 == 5), F.concat(F.lit("S-"), key.cast("string")))
        .when(style == 1, F.upper(name))
        .when(style == 2, F.concat(head, tail))
        .when(style == 3, F.concat(head, F.lit("x"), tail))
        .when((style == 4) & (key % 7 == 0), F.concat(F.lit("zz"), (turn % 50).cast("string")))
        .when(style == 5, F.concat(F.lit(" "), name, F.lit(". ")))
        .otherwise(name)
    )


def _index(spark, sf):
    return read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity_id"),
        entity_name(F.col("s_suppkey")).alias("canonical_name"),
        F.array().cast("array<string>").alias("alt_names"),
    )


def _overrides(spark, sf):
    fives = read_table(spark, sf, "supplier").filter(F.col("s_suppkey") % 10 == 5).select(F.col("s_suppkey").alias("k"))
    return fives.select(F.concat(F.lit("S-"), F.col("k").cast("string")).alias("variant"), entity_name(F.col("k")).alias("canonical"))


def _name_sql(key: str) -> str:
    letters = f"translate(md5({key}::VARCHAR), '{HEX}', '{LETTERS}')"
    return f"({letters}[1:8] || ' ' || {letters}[9:14])"


def _spelled_sql(key: str, turn: str) -> str:
    name, style, at = _name_sql(key), f"({turn} + {key}) % 6", f"(2 + {turn} % 6)"
    head, tail = f"{name}[:{at} - 1]", f"{name}[{at} + 1:]"
    return f"""CASE WHEN {style} = 0 AND {key} % 10 = 5 THEN 'S-' || {key} WHEN {style} = 1 THEN upper({name})
      WHEN {style} = 2 THEN {head} || {tail} WHEN {style} = 3 THEN {head} || 'x' || {tail}
      WHEN {style} = 4 AND {key} % 7 = 0 THEN 'zz' || ({turn} % 50) WHEN {style} = 5 THEN ' ' || {name} || '. ' ELSE {name} END"""


def _cascade_sql(names: str) -> str:
    return f"""variants AS (SELECT {_name_sql('s_suppkey')} AS choice_key, s_suppkey AS entity_id FROM supplier),
    names AS (SELECT DISTINCT name, replace(lower(trim(name)), '.', '') AS name_key FROM ({names})),
    tiers AS (SELECT n.name, n.name_key, o.s_suppkey AS override_id, v.entity_id AS exact_id FROM names n
      LEFT JOIN supplier o ON o.s_suppkey % 10 = 5 AND 'S-' || o.s_suppkey = n.name LEFT JOIN variants v ON v.choice_key = n.name_key),
    fuzzy AS ({_fuzzy_sql("(SELECT name_key FROM tiers WHERE override_id IS NULL AND exact_id IS NULL)", "variants", 80)}),
    mapping AS (SELECT t.name, coalesce(override_id, exact_id, f.entity_id) AS entity_id FROM tiers t LEFT JOIN fuzzy f
      ON f.name_key = t.name_key AND override_id IS NULL AND exact_id IS NULL)"""


_SIDES_SQL = f"""{WITH_GAMES}, spelled_games AS (SELECT game_id, {_spelled_sql('away_id', 'game_id')} AS away_name,
    {_spelled_sql('home_id', 'game_id')} AS home_name FROM games),
    {_cascade_sql('SELECT away_name AS name FROM spelled_games UNION ALL SELECT home_name FROM spelled_games')}"""


@register(
    "resolve_pairs_fuzzy",
    f"""{_SIDES_SQL} SELECT game_id, away_name, home_name, a.entity_id AS away_id, h.entity_id AS home_id
    FROM spelled_games LEFT JOIN mapping a ON a.name = away_name LEFT JOIN mapping h ON h.name = home_name""",
)
def resolve_pairs_fuzzy(spark, sf):
    """Both sides of all contests by a maintained map: the away names come first, of the home ones only new names are resolved."""
    turn = F.col("game_id")
    games = views.games(spark, sf).select(
        "game_id", spelled(F.col("away_id"), turn).alias("away_name"), spelled(F.col("home_id"), turn).alias("home_name")
    )
    games = cut_lineage(games, "named-games")
    names = NameMap(spark, scratch_path(spark, "names"))
    index, overrides = _index(spark, sf), _overrides(spark, sf)
    for batch in ("away", "home"):
        names.extend(batch, games, index, overrides, name=f"{batch}_name", scorer="edit")
    attached = names.attach(games, {"away_name": "away_id", "home_name": "home_id"})
    return attached.select("game_id", "away_name", "home_name", "away_id", "home_id")


_PERIODS_SQL = f"""{WITH_STATS}, source AS (SELECT {_spelled_sql('entity_id', '(period + sp)')} AS name, period,
      qty_season + sp AS qty_season, price_season FROM entity_stats, range(3) AS t(sp)),
    {_cascade_sql('SELECT name FROM source')}"""


@register(
    "entity_period_table_fuzzy",
    f"""{_PERIODS_SQL} SELECT entity_id, period, name, {r('qty_season')} AS qty_season, {r('price_season')} AS price_season
    FROM source JOIN mapping USING (name) WHERE entity_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY entity_id, period ORDER BY name, qty_season, price_season) = 1""",
)
def entity_period_table_fuzzy(spark, sf):
    """Statistics under three spellings each → the first spelling per resolved entity and period."""
    stats = views.entity_stats(spark, sf).select("entity_id", "period", "qty_season", "price_season")
    turns = stats.withColumn("sp", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    source = turns.select(
        spelled(F.col("entity_id"), F.col("period") + F.col("sp")).alias("name"),
        "period",
        (F.col("qty_season") + F.col("sp")).alias("qty_season"),
        "price_season",
    )
    source = cut_lineage(source, "named-stats")
    names = NameMap(spark, scratch_path(spark, "names"))
    names.extend("all", source, _index(spark, sf), _overrides(spark, sf), scorer="edit")
    resolved = drop_unresolved(names.attach(source, {"name": "entity_id"}), "entity_id")
    order = [F.col(c) for c in ("name", "qty_season", "price_season")]
    kept = first_per_key(resolved, ["entity_id", "period"], order)
    return rounded(kept.select("entity_id", "period", "name", "qty_season", "price_season"))
