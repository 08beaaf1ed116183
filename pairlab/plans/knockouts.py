"""Queries on knockout tournaments of suppliers: one per year and block of 64."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.functions.probability import logistic, prior_blend
from pairlab.operators import knockout
from pairlab.plans import views
from pairlab.plans.oracle_views import FACTS, PROFILES, WITH_SCORED, r
from pairlab.plans.registry import register, rounded
from pairlab.plans.scoring import _BLEND_SQL, blended
from pairlab.plans.views import BASE_WEIGHTS

ATTRIBUTES = ("price", "qty")
RATES = {d: round(0.45 - 0.025 * d, 3) for d in range(0, 16) if d % 5 != 4}


def field(spark, sf):
    """Seeds 1…16 by revenue within each region of sixteen suppliers."""
    key = F.col("entity_id")
    region = F.floor(key / 16)
    window = Window.partitionBy("period", region).orderBy(F.desc("revenue"), key)
    return views.profiles(spark, sf).select(
        F.concat_ws("/", "period", F.floor(key / 64)).alias("tournament"),
        (region % 4).cast("int").alias("region"),
        F.row_number().over(window).alias("seed"),
        "name",
        *ATTRIBUTES,
    )


def score(pairs, number):
    """Mean of four logistic models, pulled towards the base rate of the seed gap."""
    gaps = {c: F.coalesce(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(0.0)) for c in ("seed", *ATTRIBUTES)}
    preds = [
        F.round(
            logistic(
                F.lit(w[0]) * gaps["seed"] + F.lit(w[1]) * gaps["price"] + F.lit(w[2] * number) * gaps["qty"]
            ),
            6,
        )
        for w in BASE_WEIGHTS
    ]
    rate = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair]),
        F.abs(F.col("a_seed") - F.col("b_seed")),
    )
    staged = pairs.withColumn("_preds", F.array(*preds))
    p = F.col("_preds")
    mean = F.round((p[0] + p[1] + p[2] + p[3]) / F.lit(4.0), 9)
    return staged.withColumn("prob", F.round(prior_blend(mean, rate, p), 9)).drop("_preds")


_FIELD_SQL = f"""WITH {FACTS}, {PROFILES}, field AS (
  SELECT period || '/' || entity_id // 64 AS tournament, (entity_id // 16) % 4 AS region,
    row_number() OVER (PARTITION BY period, entity_id // 16 ORDER BY revenue DESC, entity_id) AS seed, name, price, qty FROM profiles),
shape AS (SELECT g AS region, g * 8 + i - 1 AS slot, ({[a for a, _ in knockout.SEED_PAIRS]})[i] AS sa, ({[b for _, b in knockout.SEED_PAIRS]})[i] AS sb
  FROM (SELECT unnest(range(0, 4)) AS g), (SELECT unnest(range(1, 9)) AS i)),
pairs1 AS (SELECT t.tournament, slot, sa AS a_seed, coalesce(a.name, 'TBD_' || s.region || '_' || sa) AS a_name, a.price AS a_price, a.qty AS a_qty,
    sb AS b_seed, coalesce(b.name, 'TBD_' || s.region || '_' || sb) AS b_name, b.price AS b_price, b.qty AS b_qty
  FROM (SELECT DISTINCT tournament FROM field) t JOIN shape s ON true
  LEFT JOIN field a ON a.tournament = t.tournament AND a.region = s.region AND a.seed = sa
  LEFT JOIN field b ON b.tournament = t.tournament AND b.region = s.region AND b.seed = sb)"""


def _round_sql(k: int) -> str:
    preds = [
        "round(1.0::DOUBLE / (1.0::DOUBLE + exp(-("
        f"{w[0]!r}::DOUBLE * coalesce((a_seed - b_seed)::DOUBLE, 0) + {w[1]!r}::DOUBLE * coalesce(a_price - b_price, 0)"
        f" + {w[2] * k!r}::DOUBLE * coalesce(a_qty - b_qty, 0)))), 6)"
        for w in BASE_WEIGHTS
    ]
    rates = " ".join(f"WHEN {d} THEN {v}::DOUBLE" for d, v in RATES.items())
    n = knockout.BUDGET.get(k, 0)
    votes = "((q0 < 0.5)::INTEGER + (q1 < 0.5)::INTEGER + (q2 < 0.5)::INTEGER + (q3 < 0.5)::INTEGER)"
    pull = f"(0.35::DOUBLE * (1 - pow(abs(m - 0.5) * 2, 1.2)) + CASE WHEN {votes} >= 2 THEN 0.15::DOUBLE WHEN {votes} = 1 THEN 0.08::DOUBLE ELSE 0 END)"
    tbd = "(a_name LIKE 'TBD%' OR b_name LIKE 'TBD%')"
    chance = f"(NOT {tbd} AND abs(a_seed - b_seed) < 15 AND 1 - prob > 0.20)"
    return f"""base{k} AS (SELECT *, {', '.join(f'{p} AS q{i}' for i, p in enumerate(preds))},
    CASE abs(a_seed - b_seed) {rates} END AS rate FROM pairs{k}),
mean{k} AS (SELECT *, round((q0 + q1 + q2 + q3) / 4.0::DOUBLE, 9) AS m FROM base{k}),
prob{k} AS (SELECT *, round(m * (1 - {pull}) + (1 - coalesce(rate, 0.30::DOUBLE)) * {pull}, 9) AS prob FROM mean{k}),
rank{k} AS (SELECT *, CASE WHEN {chance} THEN row_number() OVER (PARTITION BY tournament, {chance} ORDER BY 1 - prob DESC, slot) <= {n} ELSE false END AS is_forced FROM prob{k}),
res{k} AS (SELECT *, CASE WHEN a_name LIKE 'TBD%' THEN false WHEN b_name LIKE 'TBD%' THEN true WHEN is_forced THEN false ELSE prob > 0.5 END AS a_wins FROM rank{k}),
won{k} AS (SELECT *, CASE WHEN a_wins THEN a_seed ELSE b_seed END AS w_seed, CASE WHEN a_wins THEN a_name ELSE b_name END AS w_name,
  CASE WHEN a_wins THEN a_price ELSE b_price END AS w_price, CASE WHEN a_wins THEN a_qty ELSE b_qty END AS w_qty, {tbd} AS tbd FROM res{k}),
out{k} AS (SELECT tournament, {k} AS round, slot, a_seed, a_name, b_seed, b_name, prob, w_seed AS winner_seed, w_name AS winner_name,
  is_forced, NOT tbd AND (is_forced OR w_seed > least(a_seed, b_seed)) AS is_upset FROM won{k}),
pairs{k + 1} AS (SELECT x.tournament, x.slot // 2 AS slot, """ + ", ".join(
        f"CASE WHEN x.w_seed > y.w_seed THEN {p}.w_{c} ELSE {q}.w_{c} END AS {s}_{c}"
        for s, p, q in (("a", "y", "x"), ("b", "x", "y"))
        for c in ("seed", "name", "price", "qty")
    ) + f" FROM won{k} x JOIN won{k} y ON x.tournament = y.tournament AND x.slot % 2 = 0 AND y.slot = x.slot + 1)"


_OUT = (
    f"tournament, round, cast(slot AS INTEGER) AS slot, cast(a_seed AS INTEGER) AS a_seed, a_name, cast(b_seed AS INTEGER) AS b_seed, b_name, "
    f"{r('prob')} AS prob, cast(winner_seed AS INTEGER) AS winner_seed, winner_name, is_forced, is_upset"
)


@register(
    "bracket_pairs",
    f"""{_FIELD_SQL} SELECT tournament, cast(slot AS INTEGER) AS slot, cast(a_seed AS INTEGER) AS a_seed, a_name,
      cast(b_seed AS INTEGER) AS b_seed, b_name, {r('a_price')} AS a_price, {r('b_price')} AS b_price FROM pairs1""",
)
def bracket_pairs(spark, sf):
    pairs = knockout.bracket_pairs(field(spark, sf), ATTRIBUTES)
    return rounded(pairs.drop("a_qty", "b_qty"))


@register("knockout_round", f"{_FIELD_SQL}, {_round_sql(1)} SELECT {_OUT} FROM out1")
def knockout_round(spark, sf):
    pairs = knockout.bracket_pairs(field(spark, sf), ATTRIBUTES)
    return rounded(
        knockout.play_round(pairs, 1, score, ATTRIBUTES).drop(
            "winner", *[f"{s}_{c}" for s in ("a", "b") for c in ATTRIBUTES]
        )
    )


@register(
    "knockout_full",
    f"{_FIELD_SQL}, {', '.join(_round_sql(k) for k in range(1, 7))} "
    + " UNION ALL ".join(f"SELECT {_OUT} FROM out{k}" for k in range(1, 7)),
)
def knockout_full(spark, sf):
    pairs = knockout.bracket_pairs(field(spark, sf), ATTRIBUTES)
    return rounded(knockout.play_all(pairs, 6, score, ATTRIBUTES))


_BUDGET_SQL = f"CASE round_number {' '.join(f'WHEN {k} THEN {n}' for k, n in knockout.BUDGET.items())} ELSE 0 END"


@register(
    "upset_budget",
    f"""{WITH_SCORED}, {_BLEND_SQL} SELECT period, round_number, game_id, {r('final_p', 9)} AS final_p FROM blended
    WHERE abs(a_seed - b_seed) < 15 AND 1 - final_p > 0.20
    QUALIFY row_number() OVER (PARTITION BY period, round_number ORDER BY 1 - final_p DESC, game_id) <= {_BUDGET_SQL}""",
)
def upset_budget(spark, sf):
    """Forced results per year and round over all contests."""
    forced = knockout.forced_results(
        blended(spark, sf), ["period"], "round_number", prob="final_p", order="game_id"
    )
    return rounded(forced.select("period", "round_number", "game_id", "final_p"), 9)


@register(
    "champion_summary",
    f"""{_FIELD_SQL}, {', '.join(_round_sql(k) for k in range(1, 7))}, final AS (
      {' UNION ALL '.join(f'SELECT * FROM out{k}' for k in range(1, 7))})
    SELECT round, count(*) AS n, count(*) FILTER (WHERE is_upset) AS upsets, count(*) FILTER (WHERE is_forced) AS forced,
      {r('avg(winner_seed)')} AS mean_winner_seed FROM final GROUP BY round""",
)
def champion_summary(spark, sf):
    """Upsets and forced results per round over all tournaments."""
    pairs = knockout.bracket_pairs(field(spark, sf), ATTRIBUTES)
    played = knockout.play_all(pairs, 6, score, ATTRIBUTES)
    return rounded(
        played.groupBy("round").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("is_upset").alias("upsets"),
            F.count_if("is_forced").alias("forced"),
            F.avg("winner_seed").alias("mean_winner_seed"),
        )
    )
