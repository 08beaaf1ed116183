"""Exact cosine near-duplicates by a metric range join over pivot cells.

Vectors of length one lie ``r = sqrt(2 - 2 * threshold)`` apart or nearer exactly if
their cosine reaches the threshold. Pivots divide them into cells of nearest pivots. A
vector is copied into an earlier cell only if the triangle inequality leaves room for a
partner there, and each cell is then joined on its own. Every pair within ``r`` meets in
exactly one cell; pairs that meet are compared by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import input_parts, on_integer_keys, store
from pairlab.llm.components import connected_components

#: Vectors wanted in a cell, the most pivots (they are broadcast), vectors of a cell held at once,
#: copies streamed past them in one task, and rows multiplied at once.
CELL, MOST_PIVOTS, HELD, STREAMED, AT_ONCE = 2048, 1024, 4096, 32768, 2048


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return _unit_rows(np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1))


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * rows @ pivots.T, 0.0))


def _valid(embedding: str):
    """Not null, of some length, all components finite, not all zero."""
    x = F.col(embedding)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(c1, c2, node, copies, vector): one row per distinct valid vector; 128 bits of hash name it.

    ``node`` is its smallest key, ``copies`` its number of rows. Copies combine before the shuffle.
    """
    return (
        vectors.filter(F.col("valid") & F.col("key").isNotNull())
        .groupBy("c1", "c2")
        .agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("vector"))
    )


def _as_blobs(classes: DataFrame) -> DataFrame:
    """The vector as little-endian doubles."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            flat = np.asarray(lists.flatten(), np.float64)
            ends = np.cumsum([0, *(len(x) for x in lists.to_pylist())])
            blobs = [flat[i:j].astype("<f8").tobytes() for i, j in zip(ends, ends[1:])]
            columns = [batch.column(c) for c in ("c1", "c2", "node", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], ["c1", "c2", "node", "copies", "vector"])

    return classes.mapInArrow(run, "c1 bigint, c2 bigint, node bigint, copies bigint, vector binary")


def _pick_pivots(classes: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """Pivots by number of dimensions: for each, the vectors of least hash, ``wanted`` at most."""
    width = F.octet_length("vector")
    sizes = [row[0] for row in classes.select(width.alias("w")).distinct().collect()]
    return {
        size // 8: _matrix([r[0] for r in classes.filter(width == size).orderBy(F.xxhash64("c1", "c2"), "c1", "c2").limit(wanted).select("vector").collect()])
        for size in sizes
    }


def _groups_by_width(blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    widths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    for width in np.unique(widths):
        yield int(width), np.flatnonzero(widths == width)


def _nearest(classes: DataFrame, pivots: dict[int, np.ndarray], first: dict[int, int]) -> DataFrame:
    """Adds the cell of the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            blobs = batch.column("vector").to_pylist()
            cell, gap = np.zeros(len(blobs), np.int64), np.zeros(len(blobs))
            for width, rows in _groups_by_width(blobs):
                far = _distances(_matrix([blobs[i] for i in rows]), pivots[width])
                best = far.argmin(axis=1)
                cell[rows], gap[rows] = first[width] + best, far[np.arange(len(rows)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())])
    return classes.mapInArrow(run, schema)


def _visits(placed: DataFrame, pivots: dict[int, np.ndarray], first: dict[int, int], reach: dict[int, float], r: float) -> DataFrame:
    """Adds the earlier cells in which a partner may lie.

    A partner y in cell j is nearer to pivot j than to pivot i, so that for x in cell i
    d(x, j) <= r + d(y, j) <= r + reach(j), d(x, j) <= 2r + d(x, i), and x is within r
    of the plane halfway between the pivots.
    """
    apart = {width: _distances(p, p) for width, p in pivots.items()}
    slack = 1e-6

    def run(batches):
        for batch in batches:
            blobs, own = batch.column("vector").to_pylist(), batch.column("cell").to_numpy()
            lists: list[list[int]] = [[] for _ in blobs]
            for width, rows in _groups_by_width(blobs):
                far = _distances(_matrix([blobs[i] for i in rows]), pivots[width])
                home = own[rows] - first[width]
                near = far[np.arange(len(rows)), home][:, None]
                limit = np.array([reach.get(first[width] + j, -10.0) for j in range(far.shape[1])])
                plane = far**2 - near**2 <= 2 * (r + slack) * apart[width][home] + slack
                open_ = (np.arange(far.shape[1]) < home[:, None]) & (far <= limit + r + slack) & (far <= near + 2 * r + slack) & plane
                for i, row in zip(rows, open_):
                    lists[i] = (first[width] + np.flatnonzero(row)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "visits"])

    return placed.mapInArrow(run, T.StructType([*placed.schema.fields, T.StructField("visits", T.ArrayType(T.LongType()))]))


def _within(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine in double precision reaches the threshold; of one matrix, i < j."""
    rough = a.astype(np.float32) @ b.astype(np.float32).T
    i, j = np.nonzero(rough >= threshold - 1e-4 - 1e-6 * a.shape[1])
    if same:
        i, j = i[i < j], j[i < j]
    exact = [np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
    keep = np.concatenate(exact) if exact else np.zeros(0, bool)
    return i[keep], j[keep]


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each place reaches over the pairs."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Cell:
    """Members of one unit of work: those held, and those streamed past them."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.held: list[np.ndarray] = []
        self.info: list[np.ndarray] = []
        self.ready: tuple[np.ndarray, np.ndarray] | None = None

    def hold(self, rows: np.ndarray, info: np.ndarray) -> None:
        self.held.append(rows)
        self.info.append(info)

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        if self.ready is None:
            self.ready = np.concatenate(self.held), np.concatenate(self.info)
        return self.ready

    def meet(self, rows: np.ndarray | None, info: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """Links of the held rows with the given ones, or among themselves: (c1, c2, node, links, root)."""
        if not self.held:
            return
        held, known = self.members()
        for start in range(0, len(held), AT_ONCE):
            a, x = held[start : start + AT_ONCE], known[start : start + AT_ONCE]
            if rows is not None:
                yield from self._report(a, x, rows, info, False)
            else:
                yield from self._report(a, x, a, x, True)
                for other in range(start + AT_ONCE, len(held), AT_ONCE):
                    yield from self._report(a, x, held[other : other + AT_ONCE], known[other : other + AT_ONCE], False)

    def _report(self, a, x, b, y, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        i, j = _within(a, b, self.threshold, same)
        if not len(i):
            return
        both = x if same else np.concatenate([x, y])
        j = j if same else j + len(x)
        order = np.argsort(both[:, 2], kind="stable")  # a root is the least node
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = both[order[_roots(len(both), place[i], place[j])[place]], 2]
        links = np.zeros(len(both), np.int64)
        np.add.at(links, i, both[j, 3])
        np.add.at(links, j, both[i, 3])
        hit = np.flatnonzero(links)
        yield both[hit, 0], both[hit, 1], both[hit, 2], links[hit], root[hit]


def _join_units(units: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Rows (c1, c2, node, links, root) of all units. Members of a unit come in order: held ones, then streamed ones."""
    names = ["c1", "c2", "node", "links", "root"]

    def run(batches):
        unit, cell, inner = None, _Cell(threshold), False

        def close():
            return cell.meet(None, None) if inner else iter(())

        def out(found):
            for columns in found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                keys, streamed = batch.column("unit").to_numpy(), batch.column("streamed").to_numpy(zero_copy_only=False)
                within = batch.column("inner").to_numpy(zero_copy_only=False)
                info = np.stack([batch.column(c).to_numpy() for c in ("c1", "c2", "node", "copies")], axis=1)
                blobs = batch.column("vector").to_pylist()
                edges = np.flatnonzero((keys[1:] != keys[:-1]) | (streamed[1:] != streamed[:-1])) + 1
                for i, j in zip([0, *edges], [*edges, len(keys)]):
                    if keys[i] != unit:
                        yield from out(close())
                        unit, cell, inner = keys[i], _Cell(threshold), bool(within[i])
                    rows = _matrix(blobs[i:j])
                    if streamed[i]:
                        yield from out(cell.meet(rows, info[i:j]))
                    else:
                        cell.hold(rows, info[i:j])
        yield from out(close())

    placed = units.repartition(parts, "unit").sortWithinPartitions("unit", "streamed")
    return placed.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def cosine_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(c1, c2, node, links, root) per linked class and unit: how many vectors it links to, and a forest of the links.

    A cell beyond ``HELD`` members, or visited by more than ``STREAMED`` copies, is cut
    into units by hash; every two parts meet in one unit.
    """
    spark, parts = classes.sparkSession, input_parts(classes)
    r = float(np.sqrt(2.0 - 2.0 * threshold))
    pivots = _pick_pivots(classes, max(1, min(MOST_PIVOTS, -(-classes.count() // CELL))))
    starts = np.cumsum([0, *(len(p) for p in pivots.values())])
    first = {width: int(s) for width, s in zip(pivots, starts)}
    placed = store(_nearest(classes, pivots, first), "cells")
    cells = placed.groupBy("cell").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n")).collect()
    visiting = store(_visits(placed, pivots, first, {c["cell"]: c["reach"] for c in cells}, r).drop("gap"), "visits")
    copies = dict(visiting.select(F.explode("visits").alias("cell")).groupBy("cell").count().collect())
    plan = [(c["cell"], -(-c["n"] // HELD), -(-copies.get(c["cell"], 0) // STREAMED)) for c in cells]
    sizes = F.broadcast(spark.createDataFrame(plan, "cell bigint, held int, passing int"))  # a row per pivot
    spread = F.xxhash64("c2", "c1")
    natives = visiting.drop("visits").join(sizes, "cell").withColumn("own", F.pmod(spread, F.col("held")).cast("int"))
    turns = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    among = natives.withColumn("other", turns("held"))
    among = among.withColumn("unit", F.xxhash64(F.lit("n"), "cell", F.least("own", "other"), F.greatest("own", "other")))
    among = among.withColumn("streamed", F.col("own") > F.col("other")).withColumn("inner", F.col("own") == F.col("other"))
    hosts = natives.filter("passing > 0").withColumn("other", turns("passing"))
    hosts = hosts.withColumn("unit", F.xxhash64(F.lit("v"), "cell", "own", "other")).withColumn("streamed", F.lit(False))
    guests = visiting.drop("cell").withColumn("cell", F.explode("visits")).drop("visits").join(sizes, "cell")
    guests = guests.withColumn("own", F.pmod(spread, F.col("passing")).cast("int")).withColumn("other", turns("held"))
    guests = guests.withColumn("unit", F.xxhash64(F.lit("v"), "cell", "other", "own")).withColumn("streamed", F.lit(True))
    columns = ["unit", "streamed", "inner", "c1", "c2", "node", "copies", "vector"]
    units = among.select(columns)
    for more in (hosts, guests):
        units = units.unionByName(more.withColumn("inner", F.lit(False)).select(columns))
    return _join_units(units, threshold, parts)


def cosine_components(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """(key, n_links, component_id, kept): one row per vector.

    Pairs link at a cosine of ``threshold`` or more. Equal vectors are compared once and
    counted as often as they occur. Null, zero or non-finite vectors, and vectors of
    different dimensions, link with nothing; so does a row without a key, whose
    component is null and which is kept. Rows that share a key are one node of the
    components. Keys may have any type with an order. Runs jobs when called.
    """
    return on_integer_keys(vectors, key, "component_id", lambda rows: _components(rows, key, embedding, threshold))


def _components(vectors: DataFrame, key: str, embedding: str, threshold: float) -> DataFrame:
    x = F.col("embedding")
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("valid", _valid("embedding")).withColumn("c1", F.xxhash64(x)).withColumn("c2", F.xxhash64(F.lit(1), x))
    classes = store(_as_blobs(vector_classes(rows)), "classes")
    slim = classes.select("c1", "c2", "node", "copies")
    links = store(cosine_links(classes, threshold), "links")
    roots = store(connected_components(links, "node", "root").select(F.col("node"), "root"), "roots")
    sums = store(links.groupBy("c1", "c2").agg(F.sum("links").alias("links")), "sums")
    known = slim.join(sums, ["c1", "c2"], "left").join(roots, "node", "left").select(
        "c1",
        "c2",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    known = store(known, "known")
    plain = rows.select("key", (F.col("valid") & F.col("key").isNotNull()).alias("valid"), "c1", "c2")
    joined = plain.join(known, ["c1", "c2"], "left")
    own = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("key"))
    return joined.select(
        F.col("key").alias(key),
        F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(own == F.col("key"), F.lit(True)).alias("kept"),
    )
