"""Nested and shape-shifting JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SIDE = "struct<seed:string,score:string,winner:boolean,names:struct<short:string,seo:string>>"
CONTEST_SCHEMA = (
    "struct<games:array<struct<game:struct<gameID:string,startDate:string,bracketRound:string,"
    f"bracketRegion:string,gameState:string,away:{_SIDE},home:{_SIDE}>>>>"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flatten_contests(docs: DataFrame, body: str, day: str | None = None) -> DataFrame:
    """Scoreboard documents → one row per finished contest that has a round.

    Seeds that are absent, empty or no numbers are NULL; a missing score is 0 and
    a missing winner flag is false. ``day`` names the column used where a contest
    carries no date.
    """
    parsed = docs.withColumn("_doc", F.from_json(body, CONTEST_SCHEMA))
    games = parsed.select("*", F.explode("_doc.games.game").alias("_g"))
    g = "_g."
    kept = games.filter((_text(F.col(g + "bracketRound")) != "") & (F.col(g + "gameState") == "final"))
    fallback_day = F.col(day) if day else F.lit(None).cast("string")
    cols = [
        _text(F.col(g + "gameID")).alias("game_id"),
        F.coalesce(F.col(g + "startDate"), fallback_day).alias("date"),
        F.col(g + "bracketRound").alias("bracket_round"),
        _text(F.col(g + "bracketRegion")).alias("bracket_region"),
    ]
    for side in ("away", "home"):
        s = f"{g}{side}."
        cols += [
            _text(F.col(s + "names.short")).alias(f"{side}_name"),
            _text(F.col(s + "names.seo")).alias(f"{side}_seo"),
            F.nullif(F.col(s + "seed"), F.lit("")).try_cast("int").alias(f"{side}_seed"),
            F.coalesce(F.col(s + "score").try_cast("int"), F.lit(0)).alias(f"{side}_score"),
            F.coalesce(F.col(s + "winner"), F.lit(False)).alias(f"{side}_winner"),
        ]
    return kept.select(*cols)


def directory_entries(docs: DataFrame, body: str, doc_key: str) -> DataFrame:
    """Directory documents in any of three shapes → (doc_key, pos, name, slug).

    Accepts a list of records (``name``/``short`` and ``slug``/``seo``), a list of
    names, or an object keyed by slug whose values are names or records. ``pos``
    counts from 1 in document order.
    """
    raw = F.col(body)
    record = "struct<name:string,short:string,slug:string,seo:string>"
    items = F.from_json(raw, "array<string>")
    keyed = F.map_entries(F.from_json(raw, "map<string,string>"))
    is_list = F.startswith(F.ltrim(raw), F.lit("["))

    listed = F.transform(
        items,
        lambda v: F.struct(
            F.lit(None).cast("string").alias("key"), v.alias("value")
        ),
    )
    objects = F.transform(keyed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    entries = docs.select(
        doc_key, F.posexplode(F.when(is_list, listed).otherwise(objects)).alias("pos", "e")
    )
    value, key = F.col("e.value"), F.col("e.key")
    is_record = F.startswith(F.ltrim(value), F.lit("{"))
    rec = F.from_json(F.when(is_record, value), record)
    name = (
        F.when(key.isNotNull() & is_record, F.coalesce(rec["name"], key))
        .when(is_record, F.coalesce(rec["name"], rec["short"], F.lit("")))
        .otherwise(value)
    )
    plain_slug = F.translate(F.lower(value), " ", "-")
    slug = (
        F.when(key.isNotNull(), key)
        .when(is_record, F.coalesce(rec["slug"], rec["seo"], F.lit("")))
        .otherwise(plain_slug)
    )
    return entries.select(
        doc_key, (F.col("pos") + 1).alias("pos"), name.alias("name"), slug.alias("slug")
    )


