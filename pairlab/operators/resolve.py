"""Entity resolution: override, exact and fuzzy tiers, and the index they use.

An index has ``entity_id``, ``canonical_name`` and ``alt_names`` (array). Overrides
have ``variant`` and ``canonical``, one row per variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.text import normalize_key, slugify, strip_space
from pairlab.operators.fuzzy import best_matches
from pairlab.operators.ranking import assign_ids
from pairlab.session import cut_lineage


def variant_dimension(index: DataFrame) -> DataFrame:
    """(choice_key, entity_id), one row per normalised name.

    Of several entities that claim a key the one with the highest id has it.
    """
    names = F.concat(F.array("canonical_name"), F.coalesce("alt_names", F.array().cast("array<string>")))
    return (
        index.select("entity_id", F.explode(names).alias("_name"))
        .select(normalize_key(F.col("_name")).alias("choice_key"), "entity_id")
        .groupBy("choice_key")
        .agg(F.max("entity_id").alias("entity_id"))
    )


def resolve_override(names: DataFrame, overrides: DataFrame, variants: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``override_id``: the raw name is overridden and the target is in the index."""
    targets = (
        overrides.withColumn("choice_key", normalize_key(F.col("canonical")))
        .join(variants, "choice_key")
        .select(F.col("variant").alias(name), F.col("entity_id").alias("override_id"))
    )
    return names.join(targets, name, "left")


def resolve_exact(names: DataFrame, variants: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``name_key`` and ``exact_id``."""
    keyed = names.withColumn("name_key", normalize_key(F.col(name)))
    return keyed.join(
        variants.select(F.col("choice_key").alias("name_key"), F.col("entity_id").alias("exact_id")),
        "name_key",
        "left",
    )


def _blank(c: Column) -> Column:
    return c.isNull() | (strip_space(c) == "")


def resolve_cascade(
    names: DataFrame,
    index: DataFrame,
    overrides: DataFrame,
    name: str = "name",
    cutoff: float | None = 80.0,
    scorer: str = "weighted",
) -> DataFrame:
    """(name, entity_id, method, score), one row per distinct name that is not NULL.

    Tiers in order: override, exact, fuzzy (off with ``cutoff=None``). Only what
    the first two leave over is compared fuzzily. Blank names resolve to nothing.
    """
    distinct = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    variants = variant_dimension(index)
    staged = resolve_exact(resolve_override(distinct, overrides, variants), variants)
    blank = _blank(F.col("name"))
    sure = F.when(~blank, F.coalesce("override_id", "exact_id"))
    if cutoff is None:
        fuzzy_id, fuzzy_score = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        joined = staged
    else:
        leftovers = staged.filter(sure.isNull() & ~blank).select("name_key").distinct()
        matches = best_matches(leftovers, variants, cutoff, scorer).select(
            "name_key", F.col("entity_id").alias("fuzzy_id"), F.col("score").alias("fuzzy_score")
        )
        joined = staged.join(matches, "name_key", "left")
        fuzzy_id = F.when(~blank & sure.isNull(), F.col("fuzzy_id"))
        fuzzy_score = F.when(~blank & sure.isNull(), F.col("fuzzy_score"))
    method = (
        F.when(blank, F.lit("blank"))
        .when(F.col("override_id").isNotNull(), F.lit("override"))
        .when(F.col("exact_id").isNotNull(), F.lit("exact"))
        .when(fuzzy_id.isNotNull(), F.lit("fuzzy"))
        .otherwise(F.lit("unresolved"))
    )
    return joined.select(
        "name", F.coalesce(sure, fuzzy_id).alias("entity_id"), method.alias("method"), fuzzy_score.alias("score")
    )


def attach_ids(df: DataFrame, mapping: DataFrame, sides: dict[str, str]) -> DataFrame:
    """``{'away_name': 'away_id'}``: left join of the resolved distinct names per side."""
    for name, id_col in sides.items():
        df = df.join(
            mapping.select(F.col("name").alias(name), F.col("entity_id").alias(id_col)), name, "left"
        )
    return df


def resolve_pairs(
    df: DataFrame,
    index: DataFrame,
    overrides: DataFrame,
    sides: dict[str, str],
    cutoff: float | None = 80.0,
    scorer: str = "weighted",
) -> DataFrame:
    """Resolve the distinct names of all sides once, store the mapping, attach the ids.

    A small mapping is broadcast; a large one is joined by name, and adaptive
    execution splits a name that is in very many pairs.
    """
    first, *rest = [df.select(F.col(n).alias("name")).distinct() for n in sides]
    for part in rest:
        first = first.union(part)
    mapping = resolve_cascade(first, index, overrides, cutoff=cutoff, scorer=scorer)
    return attach_ids(df, cut_lineage(mapping, "mapping"), sides)


def id_to_name(ids: DataFrame, index: DataFrame, key: str) -> DataFrame:
    lookup = index.select(F.col("entity_id").alias(key), F.col("canonical_name"))
    return ids.join(lookup, key, "left")


def build_index(
    canon: DataFrame, overrides: DataFrame, names: DataFrame, cutoff: float = 85.0, scorer: str = "weighted"
) -> DataFrame:
    """Add variants to a directory (``entity_id``, ``canonical_name``).

    Every override whose target is in the directory becomes a variant. A source
    name that is no canonical name becomes one through its override, or, having
    none, through a fuzzy match with the canonical names.
    """
    base = variant_dimension(canon.withColumn("alt_names", F.array().cast("array<string>")))
    known = (
        overrides.withColumn("choice_key", normalize_key(F.col("canonical")))
        .join(base, "choice_key")
        .select("entity_id", F.col("variant").alias("alt"))
    )
    keyed = (
        names.select("name")
        .filter(F.col("name").isNotNull())
        .distinct()
        .withColumn("name_key", normalize_key(F.col("name")))
    )
    fresh = keyed.join(base.select(F.col("choice_key").alias("name_key")), "name_key", "left_anti").join(
        overrides.select(F.col("variant").alias("name")), "name", "left_anti"
    )
    fuzzy = fresh.join(best_matches(fresh, base, cutoff, scorer).select("name_key", "entity_id"), "name_key").select(
        "entity_id", F.col("name").alias("alt")
    )
    alts = known.union(fuzzy).groupBy("entity_id").agg(F.array_sort(F.collect_set("alt")).alias("alt_names"))
    return canon.join(alts, "entity_id", "left").select(
        "entity_id",
        "canonical_name",
        F.coalesce("alt_names", F.array().cast("array<string>")).alias("alt_names"),
    )


def build_index_fallback(names: DataFrame, overrides: DataFrame) -> DataFrame:
    """Index from source names alone: canonical is the override's target or the name itself."""
    mapped = (
        names.select("name")
        .filter(F.col("name").isNotNull())
        .distinct()
        .join(overrides.select(F.col("variant").alias("name"), "canonical"), "name", "left")
        .withColumn("canonical_name", F.coalesce("canonical", "name"))
    )
    grouped = mapped.groupBy("canonical_name").agg(
        F.min("name").alias("_first"),
        F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical_name"), F.col("name")))).alias(
            "alt_names"
        ),
    )
    numbered = assign_ids(grouped, ["_first"], "entity_id")
    return numbered.select(
        "entity_id", "canonical_name", slugify(F.col("canonical_name")).alias("slug"), "alt_names"
    )


def score_lookup(
    names: DataFrame, aliases: DataFrame, stats: DataFrame, name: str = "name", stat_name: str = "entity_name"
) -> tuple[DataFrame, DataFrame]:
    """Statistics of each name through its alias, and the names that have none.

    ``aliases`` has ``alias`` and ``target``; a name without one looks itself up.
    """
    mapped = names.join(
        aliases.select(F.col("alias").alias(name), F.col("target").alias("_target")), name, "left"
    ).withColumn("_target", F.coalesce("_target", name))
    keyed = stats.withColumnRenamed(stat_name, "_target")
    found = mapped.join(keyed, "_target", "left").drop("_target")
    missing = mapped.join(keyed.select("_target"), "_target", "left_anti").select(name).distinct()
    return found, missing
