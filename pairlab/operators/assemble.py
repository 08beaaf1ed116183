"""Wide per-entity tables and statistics computed from facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators.ranking import top_per_key
from pairlab.session import keep_partitions

VARIANTS = ("season", "last3", "last1", "home", "away", "prior")


def wide_assemble(
    frames: Sequence[DataFrame], keys: Sequence[str], spine: str = "all", order: Sequence[str] = ()
) -> DataFrame:
    """Merge frames into one wide row per key; ``spine="first"`` keeps only the keys of the first frame.

    A column that several frames carry is taken from the first of them. Of a frame's rows
    with one key the first counts, whole: by the columns ``order`` that the frame has, then
    the one with the fewest nulls, then the smallest values (nulls first). Null keys match
    each other. Columns must have types with an order.

    Rows travel compact: the key, the frame's number and one array per type with the
    frame's own values, so the shuffle does not grow with the columns of the other frames.
    All frames are stacked and grouped once, instead of one join (and shuffle) per frame;
    a key keeps one row of each frame in every task, however often it repeats.
    """
    if spine not in ("all", "first"):
        raise ValueError(f"unknown spine {spine!r}")
    quoted = [F.col(f"`{k}`") for k in keys]
    seen: set[str] = set(keys)
    fresh_columns: list[list[tuple[str, str]]] = []
    for frame in frames:
        own = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields if f.name not in seen]
        seen.update(name for name, _ in own)
        fresh_columns.append(own)
    kinds = list(dict.fromkeys(kind for own in fresh_columns for _, kind in own))
    place_of, values_of, first_of = (_unused(seen, name) for name in ("_frame", "_values", "_first"))

    parts = []
    for place, (frame, own) in enumerate(zip(frames, fresh_columns)):
        named = {kind: [F.col(f"`{n}`") for n, k in own if k == kind] for kind in kinds}
        arrays = [
            (F.array(*named[kind]) if named[kind] else F.lit(None)).cast(f"array<{kind}>").alias(f"_{i}")
            for i, kind in enumerate(kinds)
        ]
        nulls = sum((F.col(f"`{n}`").isNull().cast("int") for n, _ in own), F.lit(0))
        parts.append(
            frame.select(
                *quoted,
                F.lit(place).alias(place_of),
                F.struct(F.lit(0), *[F.col(f"`{c}`") for c in order if c in frame.columns]).alias(first_of),
                F.struct(nulls.alias("_nulls"), *arrays).alias(values_of),
            )
        )
    # The order may differ by frame, so each frame is cut to its first rows where it has one.
    stacked = None
    for part, frame in zip(parts, frames):
        if _has(frame, order):
            part = part.groupBy(*quoted, place_of).agg(F.min_by(values_of, F.struct(first_of, values_of)).alias(values_of))
        part = part.select(*quoted, place_of, values_of)
        stacked = part if stacked is None else stacked.unionByName(part)
    firsts = [F.min(F.when(F.col(place_of) == i, F.col(values_of))).alias(f"{values_of}{i}") for i in range(len(frames))]
    wide = stacked.groupBy(*quoted).agg(*firsts)
    if spine == "first":
        wide = wide.filter(F.col(f"{values_of}0").isNotNull())
    unfolded = []
    for i, own in enumerate(fresh_columns):
        taken = dict.fromkeys(kinds, 0)
        for name, kind in own:
            at = F.get(F.col(f"{values_of}{i}._{kinds.index(kind)}"), F.lit(taken[kind]))
            unfolded.append(at.alias(name))
            taken[kind] += 1
    return wide.select(*quoted, *unfolded)


def _unused(taken: set[str], name: str) -> str:
    while any(c.lower().startswith(name) for c in taken):
        name = f"_{name}"
    return name


def _has(frame: DataFrame, columns: Sequence[str]) -> bool:
    return any(c in frame.columns for c in columns)


def _mean(measure: Column, when: Column | None = None) -> Column:
    # Decimal sums are exact, so the mean does not depend on the order of rows.
    value = measure if when is None else F.when(when, measure)
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def stat_variants(
    facts: DataFrame,
    keys: Sequence[str],
    period: str,
    measures: Sequence[str],
    recency: Sequence[Column],
    home: Column,
    away: Column,
) -> DataFrame:
    """season / last3 / last1 / home / away / prior of each measure per (keys, period).

    The totals are one aggregation with map-side combine. The recent facts go
    through a group limit, so a key with most of the facts sends three rows per
    task, and the join of both reuses the partitioning on (keys, period).
    """
    group = [*keys, period]
    totals = facts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_facts"),
        *[
            column
            for m in measures
            for column in (
                _mean(F.col(m)).alias(f"{m}_season"),
                _mean(F.col(m), home).alias(f"{m}_home"),
                _mean(F.col(m), away).alias(f"{m}_away"),
            )
        ],
    )
    window = Window.partitionBy(*group).orderBy(*recency)
    recent = (
        facts.select(*group, *measures, F.row_number().over(window).alias("_rn"))
        .filter(F.col("_rn") <= 3)
        .groupBy(*group)
        .agg(
            *[
                column
                for m in measures
                for column in (
                    _mean(F.col(m)).alias(f"{m}_last3"),
                    _mean(F.col(m), F.col("_rn") == 1).alias(f"{m}_last1"),
                )
            ]
        )
    )
    joined = totals.join(recent, group)
    # One row per period and key: the window holds as many rows as there are periods.
    previous = Window.partitionBy(*keys).orderBy(period)
    return joined.select(
        *group,
        "n_facts",
        *[
            (F.lag(f"{m}_season").over(previous) if v == "prior" else F.col(f"{m}_{v}")).alias(f"{m}_{v}")
            for m in measures
            for v in VARIANTS
        ],
    )


def pair_dim_join(
    pairs: DataFrame,
    stats: DataFrame,
    entity: str,
    period: str,
    sides: Mapping[str, str],
    drop: Sequence[str] = (),
    salts: int = 1,
    blocks: int = 1,
) -> DataFrame:
    """Join the entity table once per side: ``{'a': 'a_id', 'b': 'b_id'}`` → ``a_*``, ``b_*``.

    Spark broadcasts the table when its size allows it and otherwise sorts and
    merges; adaptive execution splits an entity that is in very many pairs. With
    ``salts`` > 1 the pairs of every entity are spread over that many copies of
    its single row, for clusters where that split is switched off.

    One join after the other carries the first side's columns through the shuffle of the
    second. With ``blocks`` > 1 pairs travel once, without any: entities fall into that
    many cells by their hash, and period and both sides' cells name the block where a pair
    meets copies of its entities' rows. Two sides send ``2 * blocks`` copies of the table,
    at every size of it, and the pairs of an entity and period are spread over ``blocks``
    of the blocks; it pays where an entity is in more pairs of a period than that. It needs
    joins that keep partitions, which it sets for the session. Ids that are not integers or
    texts of one type on both frames are joined one after the other.
    """
    salt = ["_salt"] if salts > 1 else []
    cells = {prefix: f"_cell_{prefix}" for prefix in sides} if blocks > 1 and _same_hash(pairs, stats, entity, sides) else {}
    names = list(pairs.columns)
    out = pairs
    if salt:
        out = out.withColumn("_salt", F.pmod(F.xxhash64(*pairs.columns), F.lit(salts)).cast("int"))
    out = out.withColumns({cells[prefix]: _cell(key, blocks) for prefix, key in sides.items() if cells})
    block = [period, *cells.values(), *salt]
    if cells:
        keep_partitions(pairs.sparkSession)
        out = out.repartition(*block)
    for prefix, key in sides.items():
        renamed = prefix_rename(stats, prefix, keep=(entity, period), drop=drop)
        renamed = renamed.withColumnRenamed(entity, key)
        added = [c for c in renamed.columns if c not in (key, period)]
        names = [key, period, *[c for c in names if c not in (key, period)], *added]
        if salt:
            renamed = renamed.withColumn("_salt", _each(salts))
        for other, cell in cells.items():
            renamed = renamed.withColumn(cell, _cell(key, blocks) if other == prefix else _each(blocks))
        if cells:
            renamed = renamed.repartition(*block)
        out = out.join(renamed, [key, *block], "left")
    return out.select(*[F.col(f"`{c}`") for c in names])


def _cell(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(blocks)).cast("int")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _same_hash(pairs: DataFrame, stats: DataFrame, entity: str, sides: Mapping[str, str]) -> bool:
    """Do equal ids of all sides have equal hashes? Numbers of several types, and floating ones, need not."""
    kind = stats.schema[entity].dataType
    exact = isinstance(kind, T.IntegralType) or kind == T.StringType()
    return exact and all(pairs.schema[key].dataType == kind for key in sides.values())


def prefix_rename(df: DataFrame, prefix: str, keep: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{c}`").alias(c if c in keep else f"{prefix}_{c}")
            for c in df.columns
            if c not in drop
        ]
    )


def drop_unresolved(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def sample_unresolved(df: DataFrame, key: str, name: str, period: str, n: int = 10) -> DataFrame:
    """First ``n`` distinct unresolved names per period, for a report."""
    missing = df.filter(F.col(key).isNull()).select(period, name).distinct()
    return top_per_key(missing, [period], [F.col(name)], n)
