"""Queries on the serving path: features of arriving contests from stored statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.pairmath import LOG_FLOOR, round_digits
from pairlab.operators import state
from pairlab.operators.assemble import pair_dim_join
from pairlab.operators.features import build_pair_features
from pairlab.plans import views
from pairlab.plans.oracle_views import ROUND_NUMBER, WITH_JOINED, bucket_of, group_of, pct, r
from pairlab.plans.pairing import STATS
from pairlab.plans.registry import register
from pairlab.plans.views import MEASURES
from pairlab.session import scratch_path
from pairlab.streaming.serving import serve_features

ARRIVING = ("game_id", "period", "bracket_round", "a_id", "b_id", "a_seed", "b_seed")


def _digits(column: str) -> int:
    """Digits that hold on both engines: fewer where an average near zero divides."""
    return 4 if column.startswith("pctdiff_qty") else 6


def _stat(side: str, s: str) -> str:
    return f"({side}_{s} - 25)" if s.startswith("qty") else f"{side}_{s}"


def _log(side: str) -> str:
    return f"ln(greatest(cast({side}_seed AS DOUBLE), {LOG_FLOOR}::DOUBLE))"


def _gap(side: str, m: str) -> str:
    return f"({side}_{m}_season - {side}_{m}_away)"


def _diff(s: str) -> str:
    return f"(a_{s} - b_{s})"


_SERVED_SQL = f"""{WITH_JOINED}, arrived AS (SELECT * REPLACE (a_seed - cast(game_id % 2 AS INTEGER) AS a_seed), {ROUND_NUMBER} AS round_number FROM joined)
SELECT game_id, round_number, {group_of('round_number')} AS round_group, a_seed - b_seed AS seed_diff, a_seed + b_seed AS seed_sum,
  a_seed * b_seed AS seed_product, {r(pct('a_seed', 'b_seed'))} AS seed_pct_diff,
  {r(f"CASE WHEN a_seed IS NOT NULL AND b_seed IS NOT NULL THEN {_log('a')} - {_log('b')} END")} AS log_seed_ratio,
  {bucket_of('a_seed - b_seed')} AS seed_diff_bucket,
  {', '.join(f"{r(_diff(s))} AS diff_{s}" for s in STATS)},
  {', '.join(f"{r(pct(_stat('a', s), _stat('b', s), 'abs_clip'), _digits('pctdiff_' + s))} AS pctdiff_{s}" for s in STATS)},
  {', '.join(f"{r(_gap('a', m))} AS a_awaygap_{m}, {r(_gap('b', m))} AS b_awaygap_{m}, {r(_gap('a', m) + ' - ' + _gap('b', m))} AS diff_awaygap_{m}" for m in MEASURES)},
  {r(_diff('price_season') + ' - ' + _diff('disc_season'))} AS margin_gap,
  {r(_diff('qty_season') + ' + 0.5 * ' + _diff('tax_season') + ' - 0.3 * ' + _diff('ret_season'))} AS volume_index,
  {r(_diff('qty_last3') + ' + 0.5 * ' + _diff('tax_last3'))} AS recent_index
FROM arrived"""


def pair_server(batch, stats):
    """The serving form: logarithms floored at half a seed, averages floored by their absolute value."""
    wide = pair_dim_join(batch, stats, "entity_id", "period", {"a": "a_id", "b": "b_id"}, blocks=views.BLOCKS)
    built = build_pair_features(wide, STATS, views.COMPOSITES, denominator="abs_clip", log_floor=LOG_FLOOR)
    generated = [c for c in built.columns if c not in wide.columns]
    return built.select("game_id", *generated)


@register("serving_features", _SERVED_SQL)
def serving_features(spark, sf):
    """All contests arrive as files and are served by a stream from a published version of the statistics.

    Statistics on quantity are lowered by 25 and half the first seeds by one, so that
    averages of either sign and seeds of zero occur.
    """
    root = scratch_path(spark, "serving")
    stats = views.entity_stats(spark, sf).drop("entity_name", "n_facts")
    lowered = [(F.col(c) - 25).alias(c) if c.startswith("qty") else F.col(c) for c in stats.columns]
    state.commit(spark, f"{root}/state", {"stats": stats.select(*lowered)})
    shifted = (F.col("a_seed") - (F.col("game_id") % 2).cast("int")).alias("a_seed")
    contests = views.pairs(spark, sf).select(*[shifted if c == "a_seed" else F.col(c) for c in ARRIVING])
    contests.write.parquet(f"{root}/arrivals")
    query = serve_features(
        spark, f"{root}/arrivals", contests.schema, f"{root}/state", f"{root}/served", f"{root}/checkpoint", pair_server
    )
    query.awaitTermination()
    features = spark.read.parquet(f"{root}/served").drop("served_batch")
    doubles = [f.name for f in features.schema.fields if f.dataType.typeName() == "double"]
    return features.withColumns({c: round_digits(F.col(c), _digits(c)) for c in doubles})
