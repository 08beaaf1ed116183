"""Probabilities: ensemble rows, calibration against a prior, decisions, digamma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prior weight, confidence exponent, disagreement boosts, default rate.
PRIOR_WEIGHT = 0.35
CONFIDENCE_EXPONENT = 1.2
BOOST_ONE_VOTE, BOOST_TWO_VOTES = 0.08, 0.15
DEFAULT_RATE = 0.30
CLIP_LOW, CLIP_HIGH = 0.01, 0.99
EULER_GAMMA = 0.5772156649015329


def _present(preds: Column) -> Column:
    return F.filter(preds, lambda p: p.isNotNull())


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def simple_average(preds: Column) -> Column:
    """Mean of the predictions that exist; NULL when none does."""
    return array_mean(_present(preds))


def row_stats(preds: Column) -> dict[str, Column]:
    """Mean, population standard deviation, spread and boldest lean of one row."""
    mean = array_mean(preds)
    square = F.aggregate(
        F.transform(preds, lambda p: (p - mean) * (p - mean)), F.lit(0.0), lambda acc, v: acc + v
    )
    return {
        "mean_pred": mean,
        "std_pred": F.sqrt(F.try_divide(square, F.size(preds))),
        "spread": F.array_max(preds) - F.array_min(preds),
        "max_conf": F.array_max(F.transform(preds, lambda p: F.abs(p - F.lit(0.5)))),
    }


def prior_blend(
    prob: Column,
    rate: Column,
    preds: Column | None = None,
    weight: float = PRIOR_WEIGHT,
    default_rate: float = DEFAULT_RATE,
) -> Column:
    """Pull a probability towards a base rate, harder when the models are unsure.

    ``rate`` is how often the second side wins at this difference; a missing one
    takes the default. Votes against the first side add to the prior's weight.
    """
    prior = F.lit(1.0) - F.coalesce(rate, F.lit(default_rate))
    confidence = F.abs(prob - F.lit(0.5)) * 2
    boost: Column = F.lit(0.0)
    if preds is not None:
        votes = F.size(F.filter(preds, lambda p: p < 0.5))
        boost = (
            F.when(F.size(preds) < 2, F.lit(0.0))
            .when(votes >= 2, F.lit(BOOST_TWO_VOTES))
            .when(votes == 1, F.lit(BOOST_ONE_VOTE))
            .otherwise(F.lit(0.0))
        )
    pull = F.lit(weight) * (F.lit(1.0) - F.pow(confidence, F.lit(CONFIDENCE_EXPONENT))) + boost
    return prob * (F.lit(1.0) - pull) + prior * pull


def confidence_tier(size_high: Column, size_low: Column) -> Column:
    """HIGH for a single label at 90 %, LOW for two at 80 %, else MED."""
    return (
        F.when(size_high == 1, F.lit("HIGH")).when(size_low == 2, F.lit("LOW")).otherwise(F.lit("MED"))
    )


def agreement(preds: Column, prob: Column) -> Column:
    """How many base predictions fall on the side the final one picks."""
    return F.size(F.filter(preds, lambda p: (p > 0.5) == (prob > 0.5)))


def clip_probability(p: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    """Clip; NULL stays NULL."""
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(low)), F.lit(high)))


def decision_columns(
    prob: Column, name_a: Column, name_b: Column, seed_a: Column, seed_b: Column
) -> list[Column]:
    """Picked side, its seed and probability, and whether it is the worse seed."""
    first = prob > 0.5
    return [
        F.when(first, name_a).otherwise(name_b).alias("predicted_winner"),
        F.when(first, seed_a).otherwise(seed_b).alias("predicted_seed"),
        F.when(first, prob).otherwise(F.lit(1.0) - prob).alias("predicted_prob"),
        F.greatest(prob, F.lit(1.0) - prob).alias("confidence"),
        F.coalesce(
            (first & (seed_a > seed_b)) | (~first & (seed_b > seed_a)), F.lit(False)
        ).alias("is_upset_pick"),
    ]


def log_loss_term(p: Column, y: Column, eps: float = 2.220446049250313e-16) -> Column:
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))
    return -(y * F.ln(q) + (F.lit(1) - y) * F.ln(F.lit(1.0) - q))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def digamma(n: Column, shift: int = 16) -> Column:
    """ψ(n) for positive n: recurrence up to n+16, then the asymptotic series."""
    total: Column = F.lit(0.0)
    for i in range(shift):
        total = total + F.lit(1.0) / (n + F.lit(float(i)))
    z = n + F.lit(float(shift))
    inv2 = F.lit(1.0) / (z * z)
    series = (
        F.ln(z)
        - F.lit(0.5) / z
        - inv2 * (F.lit(1 / 12) - inv2 * (F.lit(1 / 120) - inv2 * F.lit(1 / 252)))
    )
    return series - total
