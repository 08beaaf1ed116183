"""Knockout advancement of many tournaments at once.

Pairs carry ``tournament``, ``slot``, ``a_name``, ``a_seed``, ``b_name``, ``b_seed``
and any further ``a_*``/``b_*`` attributes; a scoring function adds ``prob``, the
probability of side a.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.session import cut_lineage

# First-round seed pairs in slot order, forced results per round,
# the gap from which no result is forced, the chance below which none is.
SEED_PAIRS = ((1, 16), (8, 9), (5, 12), (4, 13), (6, 11), (3, 14), (7, 10), (2, 15))
BUDGET: Mapping[int, int] = {1: 9, 2: 3, 3: 3, 4: 2}
GAP_LIMIT = 15
MIN_CHANCE = 0.20

Score = Callable[[DataFrame, int], DataFrame]


def is_placeholder(name: Column) -> Column:
    return F.startswith(name, F.lit("TBD")) | F.startswith(name, F.lit("["))


def forced_results(
    df: DataFrame,
    by: Sequence[str],
    round_col: str,
    prob: str = "prob",
    order: str = "slot",
    budget: Mapping[int, int] = BUDGET,
) -> DataFrame:
    """The pairs whose second side is made to win: the likeliest, N per (by…, round).

    Eligible are pairs of two known sides less than fifteen seeds apart in which
    the second side has more than a 20 % chance. The largest N is a literal
    limit on the rank, so tasks drop the rest of a large group before the
    shuffle.
    """
    chance = F.lit(1.0) - F.col(prob)
    known = ~is_placeholder(F.col("a_name")) & ~is_placeholder(F.col("b_name"))
    gap = F.abs(F.col("a_seed") - F.col("b_seed"))
    eligible = df.filter(known & (gap < GAP_LIMIT) & (chance > MIN_CHANCE))
    window = Window.partitionBy(*by, round_col).orderBy(chance.desc(), F.col(order))
    allowed = F.lit(0)
    for number, n in budget.items():
        allowed = F.when(F.col(round_col) == number, F.lit(n)).otherwise(allowed)
    return (
        eligible.withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") <= max(budget.values(), default=0))
        .filter(F.col("_rn") <= allowed)
        .drop("_rn")
    )


def bracket_pairs(field: DataFrame, attributes: Sequence[str], regions: int = 4) -> DataFrame:
    """First round of every tournament from its field (tournament, region, seed, attributes…).

    ``region`` counts from 0; places nobody holds become placeholders.
    """
    slots = F.array(
        *[
            F.struct(
                F.lit(g).alias("region"),
                F.lit(g * len(SEED_PAIRS) + i).alias("slot"),
                F.lit(a).alias("a_seed"),
                F.lit(b).alias("b_seed"),
            )
            for g in range(regions)
            for i, (a, b) in enumerate(SEED_PAIRS)
        ]
    )
    grid = field.select("tournament").distinct().select("tournament", F.explode(slots).alias("s")).select(
        "tournament", "s.*"
    )
    out = grid
    for side in ("a", "b"):
        entry = field.select(
            "tournament",
            "region",
            F.col("seed").alias(f"{side}_seed"),
            *[F.col(c).alias(f"{side}_{c}") for c in ("name", *attributes)],
        )
        out = out.join(entry, ["tournament", "region", f"{side}_seed"], "left")
        vacant = F.concat(F.lit("TBD_"), F.col("region").cast("string"), F.lit("_"), F.col(f"{side}_seed").cast("string"))
        out = out.withColumn(f"{side}_name", F.coalesce(f"{side}_name", vacant))
    return out.drop("region")


def play_round(
    pairs: DataFrame,
    number: int,
    score: Score,
    attributes: Sequence[str],
    budget: Mapping[int, int] = BUDGET,
) -> DataFrame:
    """Results of one round: ``prob``, ``winner`` (struct), ``winner_name``, ``is_forced``, ``is_upset``."""
    scored = score(pairs, number).withColumn("round", F.lit(number))
    if number in budget:
        forced = forced_results(scored, ["tournament"], "round", budget=budget).select(
            "tournament", "slot", F.lit(True).alias("_forced")
        )
        scored = scored.join(forced, ["tournament", "slot"], "left")
    else:
        scored = scored.withColumn("_forced", F.lit(None).cast("boolean"))
    a_open, b_open = is_placeholder(F.col("a_name")), is_placeholder(F.col("b_name"))
    a_wins = (
        F.when(a_open, F.lit(False))
        .when(b_open, F.lit(True))
        .when(F.col("_forced"), F.lit(False))
        .otherwise(F.coalesce(F.col("prob") > 0.5, F.lit(False)))
    )

    def side(prefix: str) -> Column:
        return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in ("seed", "name", *attributes)])

    winner = F.when(a_wins, side("a")).otherwise(side("b"))
    return (
        scored.withColumn("winner", winner)
        .withColumn("winner_name", F.col("winner.name"))
        .withColumn("winner_seed", F.col("winner.seed"))
        .withColumn("is_forced", F.coalesce("_forced", F.lit(False)))
        .withColumn(
            "is_upset",
            ~a_open & ~b_open & (F.col("is_forced") | (F.col("winner_seed") > F.least("a_seed", "b_seed"))),
        )
        .drop("_forced")
    )


def next_pairs(results: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Winners of slots 2j and 2j + 1 meet in slot j; the lower seed is side a."""
    even = F.col("slot") % 2 == 0
    met = (
        results.groupBy("tournament", F.floor(F.col("slot") / 2).cast("int").alias("_slot"))
        .agg(F.max(F.when(even, F.col("winner"))).alias("x"), F.max(F.when(~even, F.col("winner"))).alias("y"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    swap = F.col("x.seed") > F.col("y.seed")
    met = met.withColumn("a", F.when(swap, F.col("y")).otherwise(F.col("x"))).withColumn(
        "b", F.when(swap, F.col("x")).otherwise(F.col("y"))
    )
    return met.select(
        "tournament",
        F.col("_slot").alias("slot"),
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("seed", "name", *attributes)],
    )


def play_all(
    pairs: DataFrame,
    rounds: int,
    score: Score,
    attributes: Sequence[str],
    budget: Mapping[int, int] = BUDGET,
) -> DataFrame:
    """Results of all rounds of all tournaments.

    Each round is frozen in the shared folder: the next one starts from stored
    winners, so the plan stays as small as one round and no round is played twice.
    """
    keep = ["tournament", "round", "slot", "a_seed", "a_name", "b_seed", "b_name", "prob",
            "winner_seed", "winner_name", "is_forced", "is_upset"]
    done = []
    current = pairs
    for number in range(1, rounds + 1):
        results = cut_lineage(play_round(current, number, score, attributes, budget).select(*keep, "winner"))
        done.append(results.select(*keep))
        current = next_pairs(results, attributes)
    return reduce(DataFrame.unionByName, done)
