"""SQL text of the same views, for an independent engine on the same tables."""

from __future__ import annotations

from pairlab.functions.pairmath import AVERAGE_FLOOR
from pairlab.plans.views import BASE_WEIGHTS, MEASURES, REGIONS, ROUND_TEXTS


def r(expr: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


def _texts(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _mean(m: str, cond: str = "true") -> str:
    return f"cast(sum({m}) FILTER (WHERE {cond}) AS DOUBLE) / nullif(count({m}) FILTER (WHERE {cond}), 0)"


FACTS = """facts AS (
  SELECT l_suppkey AS entity_id, cast(year(l_shipdate) AS INTEGER) AS period, l_linestatus, l_shipdate,
    l_orderkey, l_linenumber, l_partkey,
    cast(l_quantity AS DECIMAL(18,2)) AS qty, cast(l_extendedprice AS DECIMAL(18,2)) AS price,
    cast(l_discount AS DECIMAL(18,2)) AS disc, cast(l_tax AS DECIMAL(18,2)) AS tax,
    cast(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS ret
  FROM lineitem)"""

STATS = (
    FACTS
    + """,
totals AS (SELECT entity_id, period, count(*) AS n_facts, """
    + ", ".join(
        f"{_mean(m)} AS {m}_season, {_mean(m, chr(39).join(['l_linestatus = ', 'O', '']))} AS {m}_home, "
        f"{_mean(m, chr(39).join(['l_linestatus = ', 'F', '']))} AS {m}_away"
        for m in MEASURES
    )
    + """ FROM facts GROUP BY entity_id, period),
numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id, period ORDER BY l_shipdate DESC, l_orderkey DESC,
  l_linenumber DESC, l_partkey DESC, price DESC, qty DESC, disc DESC, tax DESC, ret DESC) AS rn FROM facts),
recent AS (SELECT entity_id, period, """
    + ", ".join(f"{_mean(m, 'rn <= 3')} AS {m}_last3, {_mean(m, 'rn = 1')} AS {m}_last1" for m in MEASURES)
    + """ FROM numbered WHERE rn <= 3 GROUP BY entity_id, period),
entity_stats AS (SELECT t.entity_id, t.period, t.n_facts, s_name AS entity_name, """
    + ", ".join(
        f"{m}_season, {m}_last3, {m}_last1, {m}_home, {m}_away, "
        f"lag({m}_season) OVER (PARTITION BY t.entity_id ORDER BY t.period) AS {m}_prior"
        for m in MEASURES
    )
    + """ FROM totals t JOIN recent USING (entity_id, period) LEFT JOIN supplier ON s_suppkey = t.entity_id)"""
)

PROFILES = """profiles AS (
  SELECT entity_id, period, s_name AS name, revenue,
    CASE WHEN entity_id % 17 <> 0 THEN cast(row_number() OVER (
      PARTITION BY period, entity_id // 16 ORDER BY revenue DESC, entity_id) AS INTEGER) END AS seed,
    cast(revenue AS DOUBLE) / n AS price, cast(q AS DOUBLE) / n AS qty
  FROM (SELECT entity_id, period, sum(price) AS revenue, sum(qty) AS q, count(*) AS n FROM facts GROUP BY ALL)
  LEFT JOIN supplier ON s_suppkey = entity_id)"""

GAMES = f"""sides AS (
  SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS points
  FROM lineitem GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_suppkey) AS rn FROM sides),
games AS (
  SELECT a.l_orderkey AS game_id, cast(o_orderdate AS DATE) AS game_date, cast(year(o_orderdate) AS INTEGER) AS period,
    a.l_suppkey AS away_id, h.l_suppkey AS home_id, cast(a.points AS DOUBLE) AS away_score,
    cast(h.points AS DOUBLE) AS home_score,
    CASE WHEN a.l_orderkey % 13 <> 0 THEN a.points > h.points END AS away_winner,
    CASE WHEN a.l_orderkey % 13 <> 0 THEN h.points > a.points END AS home_winner,
    ({_texts(ROUND_TEXTS)})[1 + a.l_orderkey % {len(ROUND_TEXTS)}] AS bracket_round,
    ({_texts(REGIONS)})[1 + a.l_orderkey % {len(REGIONS)}] AS bracket_region,
    pa.name AS away_name, ph.name AS home_name, pa.seed AS away_seed, ph.seed AS home_seed,
    pa.price AS away_price, ph.price AS home_price, pa.qty AS away_qty, ph.qty AS home_qty
  FROM placed a JOIN placed h ON a.l_orderkey = h.l_orderkey AND a.rn = 1 AND h.rn = 2
  JOIN orders ON o_orderkey = a.l_orderkey
  LEFT JOIN profiles pa ON pa.entity_id = a.l_suppkey AND pa.period = year(o_orderdate)
  LEFT JOIN profiles ph ON ph.entity_id = h.l_suppkey AND ph.period = year(o_orderdate))"""

PAIRS = (
    """turned AS (SELECT *, CASE WHEN away_seed IS NOT NULL AND home_seed IS NOT NULL THEN away_seed <= home_seed
    WHEN away_seed IS NOT NULL THEN true WHEN home_seed IS NOT NULL THEN false
    ELSE coalesce(away_name <= home_name, true) END AS away_is_a FROM games),
pairs AS (SELECT game_id, period, game_date, bracket_round, bracket_region, """
    + ", ".join(
        f"CASE WHEN away_is_a THEN away_{c} ELSE home_{c} END AS a_{c}, "
        f"CASE WHEN away_is_a THEN home_{c} ELSE away_{c} END AS b_{c}"
        for c in ("id", "name", "seed", "score", "price", "qty")
    )
    + """, CASE WHEN (CASE WHEN away_is_a THEN away_winner ELSE home_winner END) THEN 1 ELSE 0 END AS winner FROM turned)"""
)

PAIR_COLUMNS = (
    "game_id, period, game_date, bracket_round, bracket_region, a_id, b_id, a_name, b_name, "
    "a_seed, b_seed, a_score, b_score, winner"
)

ROUND_TEXT = "trim(replace(replace(lower(bracket_round), '&#174;', ''), '®', ''))"
ROUND_NUMBER = f"""CASE WHEN {ROUND_TEXT} LIKE '%first four%' THEN 0
  WHEN {ROUND_TEXT} LIKE '%first round%' OR {ROUND_TEXT} LIKE '%second round%' THEN 1
  WHEN {ROUND_TEXT} LIKE '%third round%' THEN 2
  WHEN {ROUND_TEXT} LIKE '%sweet 16%' OR {ROUND_TEXT} LIKE '%sweet sixteen%' THEN 3
  WHEN {ROUND_TEXT} LIKE '%elite 8%' OR {ROUND_TEXT} LIKE '%elite eight%' THEN 4
  WHEN {ROUND_TEXT} LIKE '%final four%' THEN 5
  WHEN {ROUND_TEXT} LIKE '%championship%' THEN 6
  WHEN regexp_full_match({ROUND_TEXT}, '[+-]?[0-9]+') THEN cast({ROUND_TEXT} AS INTEGER)
  ELSE -1 END"""


def group_of(column: str) -> str:
    return f"CASE WHEN {column} <= 0 THEN 0 WHEN {column} <= 2 THEN 1 WHEN {column} <= 4 THEN 2 ELSE 3 END"


def bucket_of(diff: str) -> str:
    return f"CASE WHEN abs({diff}) <= 3 THEN 0 WHEN abs({diff}) <= 7 THEN 1 ELSE 2 END"


def pct(a: str, b: str, denominator: str = "clip") -> str:
    average = f"(({a} + {b}) / 2.0::DOUBLE)"
    if denominator == "abs_clip":
        average = f"abs{average}"
    return f"(({a} - {b}) / greatest({average}, {AVERAGE_FLOOR}::DOUBLE))"


def _logit(w: tuple[float, ...]) -> str:
    terms = " + ".join(
        f"{value!r}::DOUBLE * coalesce(cast(a_{c} - b_{c} AS DOUBLE), 0.0::DOUBLE)"
        for value, c in zip(w, ("seed", "price", "qty"))
    )
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({terms}))), 6)"


SCORED = (
    f"""numbered_pairs AS (SELECT *, {ROUND_NUMBER} AS round_number FROM pairs),
scored AS (SELECT game_id, period, bracket_region, a_name, b_name, a_seed, b_seed, winner, round_number,
  {group_of('round_number')} AS round_group, a_seed - b_seed AS seed_diff, a_seed + b_seed AS seed_sum,
  {pct('a_seed', 'b_seed')} AS seed_pct_diff, ln(cast(a_seed AS DOUBLE)) - ln(cast(b_seed AS DOUBLE)) AS log_seed_ratio,
  {bucket_of('a_seed - b_seed')} AS seed_diff_bucket, """
    + ", ".join(f"{_logit(w)} AS p{i}" for i, w in enumerate(BASE_WEIGHTS))
    + """ FROM numbered_pairs),
ensemble AS (SELECT *, [p0, p1, p2, p3] AS preds, round((p0 + p1 + p2 + p3) / 4.0::DOUBLE, 9) AS prob FROM scored)"""
)

WITH_STATS = "WITH " + STATS
WITH_GAMES = "WITH " + ", ".join([FACTS, PROFILES, GAMES])
WITH_PAIRS = ", ".join([WITH_GAMES, PAIRS])
WITH_SCORED = ", ".join([WITH_PAIRS, SCORED])
_JOINED = (
    "joined AS (SELECT p.*, "
    + ", ".join(
        f"s{side}.{m}_{v} AS {side}_{m}_{v}"
        for side in ("a", "b")
        for m in MEASURES
        for v in ("season", "last3", "last1", "home", "away", "prior")
    )
    + " FROM pairs p LEFT JOIN entity_stats sa ON sa.entity_id = p.a_id AND sa.period = p.period"
    " LEFT JOIN entity_stats sb ON sb.entity_id = p.b_id AND sb.period = p.period)"
)
WITH_JOINED = ", ".join(["WITH " + STATS, PROFILES, GAMES, PAIRS, _JOINED])
