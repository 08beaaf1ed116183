"""Merkle manifest of a table: a tree of digests per group, and a tree over their roots.

Every level is one equijoin of its nodes with themselves on computed sibling indices,
and the nodes in slot zero then emit the parents. Proofs come down the same levels: the
path of a node is its own siblings followed by its parent's path, so each level is one
more join with half as many rows. A digest travels as 32 bytes and is hashed as hex text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import store
from pairlab.operators.ranking import assign_ids

#: Levels joined in one plan on the way down; then the paths are stored.
CHAINED = 6
_PATH = "array<struct<slot: int, siblings: binary>>"


def encode_fields(columns: Sequence[str], instead: Mapping[str, Column] | None = None) -> Column:
    """``-`` for a null, else the byte count, a colon and the value, one column after the other.

    ``instead`` gives other values to columns by name.
    """

    def one(name: str) -> Column:
        value = (instead or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.concat(*[one(c) for c in columns])


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds the slot and the digests of the run's other nodes, left to right."""
    slot = F.pmod("idx", F.lit(arity)).cast("int")
    nodes = nodes.withColumn("slot", slot)
    if arity == 2:
        targets = [F.col("idx").bitwiseXOR(F.lit(1))]
    else:
        targets = [F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + o, F.lit(arity)) for o in range(1, arity)]
    out = nodes
    for i, target in enumerate(targets):
        other = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("digest").alias(f"_d{i}"))
        out = out.withColumn("_at", target)
        out = out.join(other, (F.col("tree") == F.col("_t")) & (F.col("_at") == F.col("_i")), "left").drop("_t", "_i", "_at")
    if arity == 2:
        return out.withColumn("siblings", F.coalesce("_d0", F.lit(b""))).drop("_d0")
    found = [F.struct(F.pmod(F.col("slot") + i + 1, F.lit(arity)).alias("s"), F.col(f"_d{i}").alias("d")) for i in range(arity - 1)]
    ordered = F.array_sort(F.filter(F.array(*found), lambda x: x["d"].isNotNull()))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["d"]))
    return out.withColumn("siblings", joined).drop(*[f"_d{i}" for i in range(arity - 1)])


def build_levels(nodes: DataFrame, arity: int, label: str) -> list[DataFrame]:
    """All levels of all trees, stored, from (tree, n, idx, digest, ...); ``n`` is the tree's nodes in that level."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while True:
        level = store(_with_siblings(nodes, arity), f"{label}-level")
        levels.append(level)
        if most <= 1:
            return levels
        most = -(-most // arity)
        parents = level.filter((F.col("n") > 1) & (F.col("slot") == 0))
        nodes = parents.select(
            "tree",
            F.ceil(F.col("n") / F.lit(arity)).cast("bigint").alias("n"),
            F.expr(f"idx div {arity}").alias("idx"),
            digest(F.concat(as_hex(F.col("digest")), as_hex(F.col("siblings")))).alias("digest"),
        )


def tree_roots(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, root) of every tree, whatever its depth."""
    out = None
    for level in levels:
        part = level.filter(F.col("n") == 1).select("tree", F.col("digest").alias("root"))
        out = part if out is None else out.unionByName(part)
    return out


def paths_down(levels: Sequence[DataFrame], arity: int) -> DataFrame:
    """The lowest level with ``path``: each step up to the root with the node's slot and its siblings."""
    none = F.expr(f"cast(array() as {_PATH})")
    below = None
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at]
        if below is None:
            below = level.withColumn("path", none)
        else:
            upper = below.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_above"))
            step = F.array(F.struct("slot", "siblings")).cast(_PATH)
            on = (F.col("tree") == F.col("_t")) & (F.expr(f"idx div {arity}") == F.col("_i")) & (F.col("n") > 1)
            joined = level.join(upper, on, "left")
            path = F.when(F.col("_above").isNotNull(), F.concat(step, F.col("_above"))).otherwise(none)
            below = joined.withColumn("path", path).drop("_t", "_i", "_above")
        if at and at % CHAINED == 0:
            below = store(below.select("tree", "idx", "path"), "paths")
    return below


def fold_path(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and the digests along its path lead to."""

    def step(node: Column, s: Column) -> Column:
        left = as_hex(F.substring(s["siblings"], F.lit(1), s["slot"] * 32))
        right = as_hex(F.substring(s["siblings"], s["slot"] * 32 + 1, F.octet_length(s["siblings"])))
        return F.sha2(F.concat(left, node, right).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of all sibling digests of the path, as hex text."""
    hexes = F.transform(path, lambda s: as_hex(s["siblings"]))
    return F.sha2(F.concat_ws("", hexes).cast("binary"), 256)


def merkle_manifest(
    rows: DataFrame,
    columns: Sequence[str],
    key: str = "doc_id",
    group: str = "lang",
    arity: int = 2,
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(key, kept columns, leaf, subroot, root, path): one row per row of the table.

    A leaf is the digest of the encoded ``columns``. Leaves of a group ascend by key (null
    first), then by digest; equal rows take neighbouring places. Groups ascend bytewise,
    null first and apart from the empty text. A run is ``arity`` nodes; the last may hold
    fewer, and a lone node is hashed too while its level has others. ``keep`` names further
    columns to carry, as expressions of the input; other columns are ignored, whatever
    their names. Texts of any length count whole. An empty table has no rows and no root.
    Runs jobs when called: two a level, each over half the rows of the one before.
    """
    if arity < 2:
        raise ValueError("a run needs two nodes or more")
    kept = dict(keep or {})
    value = F.col(f"`{group}`").cast("string")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), value), F.lit("")).alias("tree"),
        F.col(f"`{key}`").alias("_key"),
        digest(encode_fields(columns)).alias("digest"),
        *[c.alias(f"_keep_{name}") for name, c in kept.items()],
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = assign_ids(store(leaves, "leaves"), ["tree", "_key", "digest", "_row"], "_id")
    trees = store(placed.groupBy("tree").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")), "trees")
    nodes = placed.join(trees, "tree").withColumn("idx", F.col("_id") - F.col("_first")).drop("_id", "_first", "_row")
    levels = build_levels(nodes, arity, "leaf")
    subroots = store(tree_roots(levels), "subroots")
    ordered = assign_ids(subroots, ["tree"], "_id").withColumn("n", F.lit(subroots.count()).cast("bigint"))
    tops = ordered.select(
        F.lit("").alias("tree"), "n", (F.col("_id") - 1).alias("idx"), F.col("root").alias("digest"), F.col("tree").alias("_group")
    )
    upper = build_levels(tops, arity, "root")
    whole = tree_roots(upper).select(F.col("root").alias("_root"), F.col("tree").alias("_top"))
    above = store(
        paths_down(upper, arity)
        .join(whole, F.col("tree") == F.col("_top"))
        .select(F.col("_group").alias("_tree"), F.col("digest").alias("_subroot"), "_root", F.col("path").alias("_upper")),
        "above",
    )
    paths = paths_down(levels, arity).join(above, F.col("tree") == F.col("_tree"))
    return paths.select(
        F.col("_key").alias(key),
        *[F.col(f"_keep_{name}").alias(name) for name in kept],
        as_hex(F.col("digest")).alias("leaf"),
        as_hex(F.col("_subroot")).alias("subroot"),
        as_hex(F.col("_root")).alias("root"),
        F.concat("path", "_upper").alias("path"),
    )

