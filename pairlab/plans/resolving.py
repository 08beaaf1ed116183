"""Queries on entity resolution. Canonical names are the part names; each part row
spells its name in one of ten ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.text import encode_variants
from pairlab.operators import ranking, resolve
from pairlab.operators.fuzzy import best_matches
from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_GAMES, WITH_STATS, r
from pairlab.plans.registry import register, rounded
from pairlab.session import read_table

STYLES = 10


def canonical_parts(spark, sf):
    return (
        read_table(spark, sf, "part")
        .groupBy(F.col("p_name").alias("canonical_name"))
        .agg(F.min("p_partkey").alias("entity_id"))
    )


def part_index(spark, sf):
    return canonical_parts(spark, sf).withColumn(
        "alt_names", F.array(F.concat(F.lit("The "), F.col("canonical_name")))
    )


def part_overrides(spark, sf):
    """Brand → first part name of the brand; one brand points to a name nobody has."""
    return (
        read_table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("variant"))
        .agg(F.min("p_name").alias("canonical"))
        .withColumn(
            "canonical",
            F.when(F.col("variant") == "Brand#7", F.lit("missing thing")).otherwise(F.initcap("canonical")),
        )
    )


def spelled_parts(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    name, style = F.col("p_name"), F.col("p_partkey") % STYLES
    turn = F.floor(F.col("p_partkey") / STYLES)
    at = (F.lit(2) + turn % (F.length(name) - 2)).cast("int")
    head, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name))
    swapped = F.concat_ws(" ", F.split(name, " ")[1], F.split(name, " ")[0])
    spelled = (
        F.when(style == 0, F.upper(name))
        .when(style == 1, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("   ")), F.lit(" ")))
        .when(style == 2, F.concat(F.substring(name, 1, 1), F.lit("."), F.substring(name, F.lit(2), F.length(name))))
        .when(style == 3, F.col("p_brand"))
        .when(style == 4, F.concat(head, tail))
        .when(style == 5, F.concat(head, F.lit("x"), tail))
        .when(style == 6, F.concat(F.lit("the "), name))
        .when(style == 7, F.concat(F.lit("zz"), F.col("p_partkey").cast("string")))
        .when((style == 8) & (turn % 2 == 0), F.lit(" "))
        .when(style == 9, swapped)
    )
    return part.select("p_partkey", "p_name", spelled.alias("name"))


_BASE_SQL = """WITH canon AS (SELECT p_name AS canonical_name, min(p_partkey) AS entity_id FROM part GROUP BY p_name),
variants AS (SELECT choice_key, max(entity_id) AS entity_id FROM (
  SELECT lower(canonical_name) AS choice_key, entity_id FROM canon
  UNION ALL SELECT 'the ' || lower(canonical_name), entity_id FROM canon) GROUP BY choice_key),
overrides AS (SELECT p_brand AS variant, CASE WHEN p_brand = 'Brand#7' THEN 'missing thing' ELSE min(p_name) END AS canonical
  FROM part GROUP BY p_brand),
placed AS (SELECT *, p_partkey % 10 AS style, p_partkey // 10 AS turn,
  2 + (p_partkey // 10) % (length(p_name) - 2) AS pos FROM part),
spelled AS (SELECT p_partkey, p_name, CASE style WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || replace(p_name, ' ', '   ') || ' '
  WHEN 2 THEN p_name[1] || '.' || p_name[2:] WHEN 3 THEN p_brand
  WHEN 4 THEN p_name[:pos - 1] || p_name[pos + 1:] WHEN 5 THEN p_name[:pos - 1] || 'x' || p_name[pos + 1:]
  WHEN 6 THEN 'the ' || p_name WHEN 7 THEN 'zz' || p_partkey WHEN 8 THEN CASE WHEN turn % 2 = 0 THEN ' ' END
  ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS name FROM placed),
names AS (SELECT DISTINCT name, regexp_replace(replace(lower(trim(name)), '.', ''), ' +', ' ', 'g') AS name_key
  FROM spelled WHERE name IS NOT NULL),
tiers AS (SELECT n.name, n.name_key, v1.entity_id AS override_id, v2.entity_id AS exact_id FROM names n
  LEFT JOIN overrides o ON o.variant = n.name LEFT JOIN variants v1 ON v1.choice_key = lower(o.canonical)
  LEFT JOIN variants v2 ON v2.choice_key = n.name_key)"""


def _sorted_words(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _similarity(a: str, b: str) -> str:
    return (
        f"(greatest(length({a}), length({b})) - levenshtein({a}, {b})) * 100.0::DOUBLE / greatest(length({a}), length({b}))"
    )


def _fuzzy_sql(names: str, choices: str, cutoff: int) -> str:
    """Every name with every choice: the brute force the prefix join must equal."""
    score = f"greatest({_similarity('name_key', 'choice_key')}, {_similarity(_sorted_words('name_key'), _sorted_words('choice_key'))})"
    return f"""SELECT name_key, choice_key, entity_id, score FROM (
      SELECT n.name_key, c.choice_key, c.entity_id, {score} AS score
      FROM (SELECT DISTINCT name_key FROM {names}) n, {choices} c)
      WHERE score >= {cutoff} QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY score DESC, entity_id, choice_key) = 1"""


_FUZZY = ", fuzzy AS (" + _fuzzy_sql(
    "(SELECT name_key FROM tiers WHERE override_id IS NULL AND exact_id IS NULL AND name_key <> '')", "variants", 80
) + ")"
_CASCADE_SQL = f"""{_BASE_SQL}{_FUZZY}, cascade AS (SELECT t.name,
  CASE WHEN t.name_key <> '' THEN coalesce(override_id, exact_id, f.entity_id) END AS entity_id,
  CASE WHEN t.name_key = '' THEN 'blank' WHEN override_id IS NOT NULL THEN 'override' WHEN exact_id IS NOT NULL THEN 'exact'
    WHEN f.entity_id IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS method,
  {r('f.score')} AS score FROM tiers t LEFT JOIN fuzzy f ON f.name_key = t.name_key
    AND override_id IS NULL AND exact_id IS NULL)"""


@register("resolve_override", f"{_BASE_SQL} SELECT name, override_id FROM tiers")
def resolve_override(spark, sf):
    names = spelled_parts(spark, sf).select("name").filter("name is not null").distinct()
    variants = resolve.variant_dimension(part_index(spark, sf))
    return resolve.resolve_override(names, part_overrides(spark, sf), variants)


@register("resolve_exact", f"{_BASE_SQL} SELECT name, name_key, exact_id FROM tiers")
def resolve_exact(spark, sf):
    names = spelled_parts(spark, sf).select("name").filter("name is not null").distinct()
    return resolve.resolve_exact(names, resolve.variant_dimension(part_index(spark, sf)))


@register(
    "resolve_fuzzy",
    f"{_BASE_SQL}, f AS ({_fuzzy_sql('names', 'variants', 80)}) "
    f"SELECT name_key, choice_key, entity_id, {r('score')} AS score FROM f",
)
def resolve_fuzzy(spark, sf):
    """Best match of every spelled name over all variants, exact ones included."""
    keyed = resolve.resolve_exact(
        spelled_parts(spark, sf).select("name").filter("name is not null").distinct(),
        resolve.variant_dimension(part_index(spark, sf)),
    )
    return rounded(best_matches(keyed.select("name_key"), resolve.variant_dimension(part_index(spark, sf)), scorer="edit"))


@register("resolve_fuzzy_weighted")
def resolve_fuzzy_weighted(spark, sf):
    """The same names by the weighted ratio; a test compares it with brute force."""
    variants = resolve.variant_dimension(part_index(spark, sf))
    keyed = resolve.resolve_exact(
        spelled_parts(spark, sf).select("name").filter("name is not null").distinct(), variants
    )
    return rounded(best_matches(keyed.select("name_key"), variants))


def _cascade(spark, sf):
    return resolve.resolve_cascade(
        spelled_parts(spark, sf), part_index(spark, sf), part_overrides(spark, sf), scorer="edit"
    )


@register("resolve_cascade", f"{_CASCADE_SQL} SELECT * FROM cascade")
def resolve_cascade(spark, sf):
    return rounded(_cascade(spark, sf))


@register(
    "resolve_report",
    f"""{_CASCADE_SQL} SELECT method, count(*) AS n_rows, count(DISTINCT s.name) AS n_names,
      sum(CASE WHEN c.entity_id = k.entity_id THEN 1 ELSE 0 END)::BIGINT AS n_right
    FROM spelled s LEFT JOIN cascade c USING (name) JOIN canon k ON k.canonical_name = s.p_name GROUP BY method""",
)
def resolve_report(spark, sf):
    """Rows and names per tier over the whole part table, and how many are right."""
    mapping = _cascade(spark, sf).select("name", F.col("entity_id").alias("got"), "method")
    truth = canonical_parts(spark, sf).withColumnRenamed("canonical_name", "p_name")
    return (
        spelled_parts(spark, sf)
        .join(mapping, "name", "left")
        .join(truth, "p_name")
        .groupBy("method")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("name").alias("n_names"),
            F.sum((F.coalesce(F.col("got") == F.col("entity_id"), F.lit(False))).cast("int")).alias("n_right"),
        )
    )


def _source_games(spark, sf):
    """Contests whose sides are named as two other sources spell them."""
    g = views.games(spark, sf)
    for side in ("away", "home"):
        key, name = F.col(f"{side}_id"), F.col(f"{side}_name")
        g = g.withColumn(
            f"{side}_name",
            F.when(key % 29 == 0, F.concat(F.lit("?"), name))
            .when(key % 3 == 0, F.upper(name))
            .when(key % 3 == 1, F.concat(F.lit(" "), name, F.lit(". ")))
            .when(key % 10 == 5, F.concat(F.lit("S-"), key.cast("string")))
            .otherwise(name),
        ).drop(f"{side}_id")
    return g.select("game_id", "away_name", "home_name")


def _source_sql(side: str) -> str:
    i, n = f"{side}_id", f"{side}_name"
    return f"""CASE WHEN {i} % 29 = 0 THEN '?' || {n} WHEN {i} % 3 = 0 THEN upper({n}) WHEN {i} % 3 = 1 THEN ' ' || {n} || '. '
    WHEN {i} % 10 = 5 THEN 'S-' || {i} ELSE {n} END AS {n}, CASE WHEN {i} % 29 <> 0 THEN {i} END AS {i}"""


@register(
    "resolve_pairs",
    f"{WITH_GAMES} SELECT game_id, {_source_sql('away')}, {_source_sql('home')} FROM games",
)
def resolve_pairs(spark, sf):
    """Both sides by override and exact tier; the names differ in digits only, so no fuzzy tier."""
    suppliers = views.supplier_names(spark, sf)
    index = suppliers.select(
        "entity_id",
        F.col("entity_name").alias("canonical_name"),
        F.array().cast("array<string>").alias("alt_names"),
    )
    overrides = suppliers.filter(F.col("entity_id") % 10 == 5).select(
        F.concat(F.lit("S-"), F.col("entity_id").cast("string")).alias("variant"),
        F.col("entity_name").alias("canonical"),
    )
    return resolve.resolve_pairs(
        _source_games(spark, sf),
        index,
        overrides,
        {"away_name": "away_id", "home_name": "home_id"},
        cutoff=None,
    )


@register(
    "id_to_name",
    """SELECT l_suppkey AS entity_id, count(*) AS n, CASE WHEN l_suppkey % 7 <> 0 THEN s_name END AS canonical_name
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_name""",
)
def id_to_name(spark, sf):
    ids = (
        read_table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("entity_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    index = views.supplier_names(spark, sf).filter(F.col("entity_id") % 7 != 0)
    return resolve.id_to_name(ids, index.withColumnRenamed("entity_name", "canonical_name"), "entity_id")


_CANON_CHOICES = "(SELECT lower(canonical_name) AS choice_key, entity_id FROM canon)"


@register(
    "build_index",
    f"""{_BASE_SQL}, fresh AS (SELECT name, name_key FROM names WHERE name_key NOT IN (SELECT lower(canonical_name) FROM canon)
      AND name NOT IN (SELECT variant FROM overrides) AND name_key <> ''),
    f AS ({_fuzzy_sql('fresh', _CANON_CHOICES, 85)}),
    alts AS (SELECT entity_id, variant AS alt FROM overrides JOIN canon ON canonical_name = canonical
      UNION SELECT f.entity_id, name FROM fresh JOIN f USING (name_key))
    SELECT canon.entity_id, canonical_name, coalesce('["' || string_agg(alt, '","' ORDER BY alt) || '"]', '[]') AS alt_names
    FROM canon LEFT JOIN alts USING (entity_id) GROUP BY ALL""",
)
def build_index(spark, sf):
    built = resolve.build_index(
        canonical_parts(spark, sf), part_overrides(spark, sf), spelled_parts(spark, sf), scorer="edit"
    )
    return built.withColumn("alt_names", encode_variants(F.col("alt_names")))


@register(
    "build_index_fallback",
    f"""{_BASE_SQL}, mapped AS (SELECT name, coalesce(CASE WHEN variant = 'Brand#7' THEN 'missing thing' ELSE canonical END, name) AS canonical_name
      FROM names LEFT JOIN overrides ON variant = name)
    SELECT row_number() OVER (ORDER BY min(name)) AS entity_id, canonical_name,
      replace(lower(canonical_name), ' ', '-') AS slug,
      coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE name <> canonical_name), '') AS alt_names
    FROM mapped GROUP BY canonical_name""",
)
def build_index_fallback(spark, sf):
    overrides = part_overrides(spark, sf).withColumn("canonical", F.lower("canonical"))
    built = resolve.build_index_fallback(spelled_parts(spark, sf), overrides)
    return built.withColumn("alt_names", F.array_join("alt_names", "|"))


@register(
    "assign_ids",
    """SELECT p_type, p_name, row_number() OVER (ORDER BY p_name, p_type) AS id FROM (SELECT DISTINCT p_name, p_type FROM part)""",
)
def assign_ids(spark, sf):
    names = read_table(spark, sf, "part").select("p_name", "p_type").distinct()
    return ranking.assign_ids(names, ["p_name", "p_type"])


_LOOKUP_SQL = f"""{WITH_STATS}, field AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Alias ' || s_suppkey
  WHEN s_suppkey % 9 = 0 THEN 'Nobody ' || s_suppkey ELSE s_name END AS name, s_name FROM supplier)"""


def _field(spark, sf):
    key, name = F.col("s_suppkey"), F.col("s_name")
    return read_table(spark, sf, "supplier").select(
        F.when(key % 4 == 0, F.concat(F.lit("Alias "), key.cast("string")))
        .when(key % 9 == 0, F.concat(F.lit("Nobody "), key.cast("string")))
        .otherwise(name)
        .alias("name")
    )


def _lookup(spark, sf):
    aliases = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("Alias "), F.col("s_suppkey").cast("string")).alias("alias"),
        F.col("s_name").alias("target"),
    )
    stats = views.entity_stats(spark, sf).filter(F.col("period") == 1998)
    return resolve.score_lookup(
        _field(spark, sf), aliases, stats.select("entity_name", "qty_season", "price_season")
    )


@register(
    "score_lookup",
    f"""{_LOOKUP_SQL} SELECT field.name, {r('qty_season')} AS qty_season, {r('price_season')} AS price_season FROM field
      LEFT JOIN entity_stats ON entity_name = s_name AND period = 1998 AND field.name NOT LIKE 'Nobody%'""",
)
def score_lookup(spark, sf):
    return rounded(_lookup(spark, sf)[0])


@register("score_lookup_missing", f"{_LOOKUP_SQL} SELECT name FROM field WHERE name LIKE 'Nobody%'")
def score_lookup_missing(spark, sf):
    return _lookup(spark, sf)[1]
