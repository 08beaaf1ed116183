"""Queries on pairs: orientation, dimension joins, generated features, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.pairmath import diff_bucket, pair_arith, round_digits, safe_diff, safe_pct_diff
from pairlab.functions.text import normalize_category
from pairlab.operators import assemble, features, resolve
from pairlab.operators.pairs import period_counts, unresolved
from pairlab.operators.ranking import first_per_key
from pairlab.plans import views
from pairlab.plans.oracle_views import (
    PAIR_COLUMNS,
    ROUND_NUMBER,
    WITH_GAMES,
    WITH_JOINED,
    WITH_PAIRS,
    WITH_SCORED,
    WITH_STATS,
    bucket_of,
    group_of,
    pct,
    r,
)
from pairlab.plans.registry import register, rounded
from pairlab.plans.views import MEASURES
from pairlab.sources.files import union_diagonal

VARIANTS = assemble.VARIANTS
STATS = [f"{m}_{v}" for m in MEASURES for v in VARIANTS]
STATS_SQL = ", ".join(f"{r(s)} AS {s}" for s in STATS)


@register("orient_pairs", f"{WITH_PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def orient(spark, sf):
    return views.pairs(spark, sf)


@register(
    "stat_variants",
    f"{WITH_STATS} SELECT entity_id, period, n_facts, {STATS_SQL} FROM entity_stats",
)
def stat_variants(spark, sf):
    return rounded(views.entity_stats(spark, sf).drop("entity_name"))


@register("wide_assemble", f"{WITH_STATS} SELECT entity_id, period, {STATS_SQL} FROM entity_stats")
def wide_assemble(spark, sf):
    stats = views.entity_stats(spark, sf)
    frames = [
        stats.select("entity_id", "period", *[f"{m}_{v}" for v in VARIANTS])
        for m in MEASURES
    ]
    # The second file repeats a column of the first; the first one is kept.
    frames[1] = frames[1].withColumn("qty_season", F.lit(-1.0))
    return rounded(assemble.wide_assemble(frames, ["entity_id", "period"]))


JOINED_SQL = ", ".join(f"{r(f'{side}_{s}')} AS {side}_{s}" for side in ("a", "b") for s in STATS)


@register("pair_dim_join", f"{WITH_JOINED} SELECT {PAIR_COLUMNS}, {JOINED_SQL} FROM joined")
def pair_dim_join(spark, sf):
    return rounded(views.joined_pairs(spark, sf))


@register(
    "prefix_rename",
    f"{WITH_STATS} SELECT entity_id, period, {', '.join(f'{r(s)} AS a_{s}' for s in STATS)} FROM entity_stats",
)
def prefix_rename(spark, sf):
    stats = views.entity_stats(spark, sf)
    return rounded(
        assemble.prefix_rename(stats, "a", ("entity_id", "period"), drop=("entity_name", "n_facts"))
    )


@register(
    "stat_diff",
    f"{WITH_JOINED} SELECT game_id, "
    + ", ".join(f"{r(f'a_{s} - b_{s}')} AS diff_{s}" for s in STATS)
    + " FROM joined",
)
def stat_diff(spark, sf):
    df = views.joined_pairs(spark, sf)
    return rounded(df.select("game_id", *features.stat_diffs(df, STATS)))


@register(
    "stat_pctdiff",
    f"{WITH_JOINED} SELECT game_id, "
    + ", ".join(
        f"{r(pct(f'a_{s}', f'b_{s}'))} AS pctdiff_{s}, "
        f"{r(pct(f'(a_{s} - 25)', f'(b_{s} - 25)', 'abs_clip'), 4)} AS pctdiff_less25_{s}"
        for s in STATS
    )
    + " FROM joined",
)
def stat_pctdiff(spark, sf):
    """Both denominators of every statistic; the lowered twin has averages of either sign."""
    df = views.joined_pairs(spark, sf)
    sides = [f"{side}_{s}" for side in ("a", "b") for s in STATS]
    twins = [(F.col(c) - 25).alias(f"{c[:2]}less25_{c[2:]}") for c in sides]
    both = df.select("game_id", *sides, *twins)
    plain = features.stat_pctdiffs(both, STATS)
    lowered = features.stat_pctdiffs(both, [f"less25_{s}" for s in STATS], "abs_clip")
    named = both.select("game_id", *plain, *lowered)
    return named.select(
        "game_id",
        *[round_digits(F.col(f"pctdiff_{s}"), 6).alias(f"pctdiff_{s}") for s in STATS],
        *[round_digits(F.col(f"pctdiff_less25_{s}"), 4).alias(f"pctdiff_less25_{s}") for s in STATS],
    )


@register(
    "variant_gap",
    f"{WITH_JOINED} SELECT game_id, "
    + ", ".join(
        f"{r(f'a_{m}_season - a_{m}_away')} AS a_awaygap_{m}, {r(f'b_{m}_season - b_{m}_away')} AS b_awaygap_{m}, "
        f"{r(f'(a_{m}_season - a_{m}_away) - (b_{m}_season - b_{m}_away)')} AS diff_awaygap_{m}"
        for m in MEASURES
    )
    + " FROM joined",
)
def variant_gap(spark, sf):
    df = views.joined_pairs(spark, sf)
    return rounded(df.select("game_id", *features.variant_gaps(df, STATS)))


def _d(s: str) -> str:
    return f"(a_{s} - b_{s})"


@register(
    "composite_index",
    f"{WITH_JOINED} SELECT game_id, {r(_d('price_season') + ' - ' + _d('disc_season'))} AS margin_gap, "
    f"{r(_d('qty_season') + ' + 0.5 * ' + _d('tax_season') + ' - 0.3 * ' + _d('ret_season'))} AS volume_index, "
    f"{r(_d('qty_last3') + ' + 0.5 * ' + _d('tax_last3'))} AS recent_index FROM joined",
)
def composite_index(spark, sf):
    df = views.joined_pairs(spark, sf)
    return rounded(df.select("game_id", *features.composites(df, views.COMPOSITES)))


@register(
    "pair_arith",
    f"""{WITH_PAIRS} SELECT game_id, a_seed - b_seed AS seed_diff, a_seed + b_seed AS seed_sum,
    a_seed * b_seed AS seed_product, {r(pct('a_seed', 'b_seed'))} AS seed_pct_diff,
    {r('ln(cast(a_seed AS DOUBLE)) - ln(cast(b_seed AS DOUBLE))')} AS log_seed_ratio FROM pairs""",
)
def pair_arithmetic(spark, sf):
    df = views.pairs(spark, sf)
    return rounded(df.select("game_id", *pair_arith(F.col("a_seed"), F.col("b_seed"))))


@register(
    "diff_bucket", f"{WITH_PAIRS} SELECT game_id, {bucket_of('a_seed - b_seed')} AS seed_diff_bucket FROM pairs"
)
def bucket(spark, sf):
    df = views.pairs(spark, sf)
    return df.select("game_id", diff_bucket(F.col("a_seed") - F.col("b_seed")).alias("seed_diff_bucket"))


@register(
    "normalize_category",
    f"{WITH_GAMES} SELECT game_id, bracket_round, {ROUND_NUMBER} AS round_number FROM games",
)
def round_numbers(spark, sf):
    number = normalize_category(F.col("bracket_round")).alias("round_number")
    return views.games(spark, sf).select("game_id", "bracket_round", number)


@register(
    "ordinal_group",
    f"{WITH_GAMES} SELECT game_id, {group_of('round_number')} AS round_group "
    f"FROM (SELECT *, {ROUND_NUMBER} AS round_number FROM games)",
)
def group(spark, sf):
    return features.with_rounds(views.games(spark, sf)).select("game_id", "round_group")


@register(
    "safe_pct_diff",
    f"""{WITH_JOINED} SELECT game_id, {r('a_ret_last1 - b_ret_last1')} AS ret_diff,
    {r('CASE WHEN (a_ret_last1 + b_ret_last1) / 2 = 0 THEN 0.0::DOUBLE ELSE (a_ret_last1 - b_ret_last1) / ((a_ret_last1 + b_ret_last1) / 2) END')}
    AS ret_pct FROM joined""",
)
def safe_pct(spark, sf):
    df = views.joined_pairs(spark, sf)
    a, b = F.col("a_ret_last1"), F.col("b_ret_last1")
    return rounded(df.select("game_id", safe_diff(a, b).alias("ret_diff"), safe_pct_diff(a, b).alias("ret_pct")))


def _imputed_sql() -> str:
    dirty = "CASE WHEN period % 3 = 0 THEN 'NaN'::DOUBLE WHEN period % 3 = 1 THEN qty_prior ELSE qty_season END"
    return (
        f"{WITH_STATS} SELECT entity_id, period, "
        f"{r('coalesce(CASE WHEN isnan(v) THEN 0 ELSE v END, 0)')} AS x FROM "
        f"(SELECT entity_id, period, {dirty} AS v FROM entity_stats)"
    )


@register("impute_zero", _imputed_sql())
def impute(spark, sf):
    stats = views.entity_stats(spark, sf)
    dirty = (
        F.when(F.col("period") % 3 == 0, F.lit(float("nan")))
        .when(F.col("period") % 3 == 1, F.col("qty_prior"))
        .otherwise(F.col("qty_season"))
    )
    return rounded(stats.select("entity_id", "period", features.impute_zero(dirty).alias("x")))


@register(
    "unpivot_features",
    f"""{WITH_STATS} SELECT entity_id, period, feature, pos, {r('coalesce(x, 0)')} AS x FROM ("""
    + " UNION ALL ".join(
        f"SELECT entity_id, period, '{s}' AS feature, {i} AS pos, {s} AS x FROM entity_stats"
        for i, s in enumerate(STATS)
    )
    + ")",
)
def unpivot_features(spark, sf):
    stats = views.entity_stats(spark, sf)
    return rounded(features.to_long(stats, STATS, ["entity_id", "period"]))


GENERATED = (
    ["round_number", "round_group", "seed_diff", "seed_sum", "seed_product", "seed_pct_diff", "log_seed_ratio",
     "seed_diff_bucket"]
    + [f"diff_{s}" for s in STATS]
    + [f"pctdiff_{s}" for s in STATS]
    + [f"diff_awaygap_{m}" for m in MEASURES]
    + ["margin_gap", "volume_index", "recent_index"]
)
EXCLUDED = ("game_id", "period", "game_date", "bracket_round", "bracket_region", "winner")


@register(
    "select_by_pattern",
    f"{WITH_JOINED} SELECT f.feature, count(*) AS n_rows FROM joined, (SELECT unnest(["
    + ", ".join(f"'{g}'" for g in GENERATED)
    + "]) AS feature) f GROUP BY f.feature",
)
def select_by_pattern(spark, sf):
    """Candidate features of the full feature table, with its row count."""
    df = views.pair_features(spark, sf)
    names = features.pick_features(df, EXCLUDED)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(F.explode(F.array(*[F.lit(x) for x in names])).alias("feature"), "n_rows")


FEATURE_SETS = {
    "curated": ("seed_diff", "seed_sum", "margin_gap", "diff_qty_season", "diff_price_season", "diff_disc_season"),
    "close": ("seed_pct_diff", "diff_qty_last3", "diff_awaygap_qty", "diff_price_last3", "diff_ret_season"),
    "late": ("seed_pct_diff", "log_seed_ratio", "diff_tax_season", "diff_tax_away", "diff_never_collected"),
}
_SET_PARTS = {
    "seed_diff": "cast(a_seed - b_seed AS DOUBLE)",
    "seed_sum": "cast(a_seed + b_seed AS DOUBLE)",
    "margin_gap": _d("price_season") + " - " + _d("disc_season"),
    "seed_pct_diff": pct("a_seed", "b_seed"),
    "log_seed_ratio": "ln(cast(a_seed AS DOUBLE)) - ln(cast(b_seed AS DOUBLE))",
    "diff_awaygap_qty": "(a_qty_season - a_qty_away) - (b_qty_season - b_qty_away)",
}


def _sets_sql() -> str:
    parts = []
    for name, wanted in FEATURE_SETS.items():
        kept = [f for f in wanted if f != "diff_never_collected"]
        for pos, f in enumerate(kept):
            value = _SET_PARTS.get(f) or _d(f.removeprefix("diff_"))
            parts.append(
                f"SELECT '{name}' AS set_name, {pos} AS pos, '{f}' AS feature, count(*) AS n, "
                f"round(avg(round(coalesce({value}, 0), 9)), 5) + 0.0 AS mean FROM joined"
            )
    return f"{WITH_JOINED} " + " UNION ALL ".join(parts)


@register("feature_sets", _sets_sql())
def feature_sets(spark, sf):
    """Mean of every feature of each regime's set, over all pairs."""
    df = views.pair_features(spark, sf)
    sets = features.feature_sets(df, FEATURE_SETS)
    wanted = sorted({f for fs in FEATURE_SETS.values() for f in features.available(df, fs)})
    means = (
        features.to_long(df, wanted, ["game_id"])
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round("x", 9)), 5).alias("mean"))
    )
    return means.join(F.broadcast(sets), "feature")


@register(
    "qa_counts",
    f"{WITH_PAIRS} SELECT period, count(*) AS n FROM pairs GROUP BY ROLLUP (period)",
)
def qa_counts(spark, sf):
    return period_counts(views.pairs(spark, sf))


def _with_gaps(df, entity="a_id"):
    return df.withColumn(entity, F.when(F.col(entity) % 29 != 0, F.col(entity)))


@register(
    "qa_unresolved",
    f"""{WITH_PAIRS}, gaps AS (SELECT period, a_name AS name FROM pairs WHERE a_id % 29 = 0
      UNION SELECT period, b_name FROM pairs WHERE b_id % 29 = 0),
    n AS (SELECT period, count(*) AS n_pairs FROM pairs WHERE a_id % 29 = 0 OR b_id % 29 = 0 GROUP BY period)
    SELECT gaps.period, name, n_pairs FROM gaps JOIN n USING (period)
    QUALIFY row_number() OVER (PARTITION BY gaps.period ORDER BY name) <= 10""",
)
def qa_unresolved(spark, sf):
    """Pairs with an unresolved side per period, and the first ten names."""
    df = _with_gaps(_with_gaps(views.pairs(spark, sf)), "b_id")
    lost = unresolved(df)
    sides = lost.select("period", F.col("a_id").alias("id"), F.col("a_name").alias("name")).unionAll(
        lost.select("period", "b_id", "b_name")
    )
    counts = lost.groupBy("period").agg(F.count(F.lit(1)).alias("n_pairs"))
    return assemble.sample_unresolved(sides, "id", "name", "period").join(counts, "period")


@register(
    "filter_labelled",
    f"""{WITH_GAMES} SELECT game_id, period, away_winner FROM games WHERE away_winner IS NOT NULL""",
)
def filter_labelled(spark, sf):
    return assemble.drop_unresolved(views.games(spark, sf), "away_winner").select(
        "game_id", "period", "away_winner"
    )


@register(
    "fold_split",
    f"""{WITH_PAIRS} SELECT CASE WHEN period = 1998 THEN 'test' ELSE 'train' END AS part, count(*) AS n,
    sum(winner)::BIGINT AS wins FROM pairs GROUP BY ALL""",
)
def fold_split(spark, sf):
    train, test = features.fold_split(views.pairs(spark, sf), "period", 1998)
    tagged = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("winner").alias("wins"))


@register(
    "regime_filter",
    f"""{WITH_SCORED} SELECT game_id, abs(seed_diff) <= 7 AS is_close, round_number >= 3 AS is_late
    FROM scored WHERE abs(seed_diff) <= 7 OR round_number >= 3""",
)
def regime_filter(spark, sf):
    close, late = features.regime_close(), features.regime_late()
    return (
        views.scored(spark, sf)
        .filter(close | late)
        .select("game_id", close.alias("is_close"), late.alias("is_late"))
    )


@register(
    "min_support",
    f"""{WITH_SCORED}, c AS (SELECT period, count(*) FILTER (WHERE abs(seed_diff) <= 7) AS close,
      count(*) FILTER (WHERE round_number >= 6) AS late FROM scored GROUP BY period),
    l AS (SELECT period, 'close' AS regime, close AS n_own, 20 AS least FROM c
      UNION ALL SELECT period, 'late', late, 500 FROM c)
    SELECT period, regime, (sum(n_own) OVER (PARTITION BY regime) - n_own)::BIGINT AS n_train,
      (sum(n_own) OVER (PARTITION BY regime) - n_own) >= least AS fitted FROM l""",
)
def min_support(spark, sf):
    regimes = {"close": (features.regime_close(), 20), "late": (features.regime_late(start=6), 500)}
    return features.fold_support(views.scored(spark, sf), "period", regimes)


@register(
    "dedup_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def dedup_first(spark, sf):
    orders = views.read_table(spark, sf, "orders")
    return first_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


@register("distinct_periods", f"{WITH_GAMES} SELECT DISTINCT period FROM games")
def distinct_periods(spark, sf):
    return views.games(spark, sf).select("period").distinct().orderBy("period")


@register(
    "union_diagonal",
    """SELECT o_orderkey AS id, cast(o_custkey AS DOUBLE) AS owner, o_totalprice AS amount, NULL::VARCHAR AS segment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, NULL FROM supplier""",
)
def diagonal(spark, sf):
    """Frames whose columns differ and whose common column is once an integer."""
    orders = views.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("amount")
    )
    customers = views.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("owner"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = views.read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("owner")
    )
    return union_diagonal([orders, customers, suppliers])


_SPELLINGS_SQL = f"""{WITH_STATS}, twice AS (SELECT entity_id, period, entity_name AS name, 0 AS sp, qty_season, price_season FROM entity_stats
    UNION ALL SELECT entity_id, period, upper(entity_name) || '.', 1, qty_season + 1, price_season FROM entity_stats WHERE entity_id % 2 = 0
    UNION ALL SELECT entity_id, period, 'lost ' || entity_id, 2, qty_season, price_season FROM entity_stats WHERE entity_id % 5 = 0)"""


@register(
    "entity_period_table",
    f"""{_SPELLINGS_SQL} SELECT entity_id, period, name, {r('qty_season')} AS qty_season, {r('price_season')} AS price_season FROM twice
    WHERE sp < 2 QUALIFY row_number() OVER (PARTITION BY entity_id, period ORDER BY name) = 1""",
)
def entity_period_table(spark, sf):
    """Statistics under source names → one row per resolved entity and period.

    Names are resolved once each, rows without an entity are dropped, and of two
    spellings of an entity the first is kept.
    """
    stats = views.entity_stats(spark, sf).select("entity_id", "period", "entity_name", "qty_season", "price_season")
    even, fifth = F.col("entity_id") % 2 == 0, F.col("entity_id") % 5 == 0
    spelled = stats.select(
        "period",
        "price_season",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("entity_name").alias("name"), F.col("qty_season").alias("qty_season")),
                    F.when(even, F.struct(F.concat(F.upper("entity_name"), F.lit(".")).alias("name"), (F.col("qty_season") + 1).alias("qty_season"))),
                    F.when(fifth, F.struct(F.concat(F.lit("lost "), F.col("entity_id").cast("string")).alias("name"), F.col("qty_season").alias("qty_season"))),
                ),
                lambda s: s.isNotNull(),
            )
        ).alias("s"),
    ).select("period", "s.name", "s.qty_season", "price_season")
    index = views.supplier_names(spark, sf).select(
        "entity_id", F.col("entity_name").alias("canonical_name"), F.array().cast("array<string>").alias("alt_names")
    )
    nothing = spark.createDataFrame([], "variant string, canonical string")
    resolved = resolve.resolve_pairs(spelled, index, nothing, {"name": "entity_id"}, cutoff=None)
    kept = first_per_key(assemble.drop_unresolved(resolved, "entity_id"), ["entity_id", "period"], [F.col("name")])
    return rounded(kept.select("entity_id", "period", "name", "qty_season", "price_season"))
