"""Exact top-k inner products by best-first search in M-trees.

Integer vectors x get one more component, sqrt(M² - |x|²), where M is the greatest norm;
a query q gets none. Then d(q, x)² = |q|² + M² - 2 q·x, so the nearest vectors are those
of the highest inner products, and the triangle inequality holds. Pivots divide the
vectors into cells, cells into units of bounded size, and every unit is an M-tree whose
pages hold routing vectors, covering radii and distances to the parent. A search opens
pages in the order of their least possible distance; entries that the stored distances
rule out are never computed. Distances only order and exclude, with a margin for their
rounding; scores are integer products.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import input_parts, store

#: Vectors wanted in a cell, the most pivots (they are broadcast), vectors of a unit (one tree), units of a
#: task, entries of a page, rows taken at once, and the share of a norm by which distances may be off.
CELL, MOST_PIVOTS, UNIT, UNITS_A_TASK, PAGE, BLOCK, SLACK = 4096, 1024, 4096, 16, 64, 256, 1e-6
#: Sums of products below this are exact in 64 bits; components from ``HUGE`` on count as infinite.
_SAFE, HUGE = 2.0**62, 1e140
_LEAST, _MOST = -(2**63), 2**63 - 1


def integer_vector(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale · x) as integers: 64 bits where they fit, else Python's own."""
    low = np.floor(values * scale)
    if len(low) and np.abs(low).max() >= 2.0**53:
        return np.array([int(v) for v in low], object)
    return low.astype(np.int64)


def sortable(score: int) -> str:
    """A text that sorts as the number does: sign, number of digits, digits; turned round below zero."""
    digits = str(abs(score))
    if score >= 0:
        return f"p{len(digits):04d}{digits}"
    return f"n{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def inner_products(rows: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    """Exact products of integer rows with an integer query; ``safe`` if their norms say that 64 bits hold them."""
    if safe and rows.dtype != object and query.dtype != object:
        return rows @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows], object)


@dataclass
class Page:
    """One page: a leaf holds places of vectors, another one its child pages.

    ``parent`` has the distance of each entry to this page's own routing vector, ``radius``
    the covering radius of each child (0 in a leaf).
    """

    leaf: bool
    entries: np.ndarray
    parent: np.ndarray
    radius: np.ndarray


class MTree:
    """An M-tree over augmented vectors, packed from above: every page takes its routing vectors from its own members."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.pages: list[Page] = []
        self.routing: list[int] = []
        everyone = np.arange(len(points))
        middle = self._far(points.mean(axis=0), everyone).argmin()
        self.root = self._build(everyone, int(middle))
        self.reach = float(self._far(points[middle], everyone).max())

    def _far(self, point: np.ndarray, places: np.ndarray) -> np.ndarray:
        gap = self.points[places] - point
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _build(self, places: np.ndarray, centre: int) -> int:
        own = self._far(self.points[centre], places)
        at = len(self.pages)
        self.pages.append(None)
        self.routing.append(centre)
        picks = self._spread(places) if len(places) > PAGE else []
        if len(picks) < 2:  # few vectors, or copies of one
            self.pages[at] = Page(True, places, own, np.zeros(len(places)))
            return at
        far = np.stack([self._far(self.points[p], places) for p in picks])
        home = far.argmin(axis=0)
        children, parent, radius = [], [], []
        for i, pick in enumerate(picks):
            mine = np.flatnonzero(home == i)
            if len(mine):
                children.append(self._build(places[mine], int(pick)))
                parent.append(float(self._far(self.points[centre], np.array([pick]))[0]))
                radius.append(float(far[i, mine].max()))
        self.pages[at] = Page(False, np.array(children), np.array(parent), np.array(radius))
        return at

    def _spread(self, places: np.ndarray) -> list[int]:
        """Routing vectors far apart: each the farthest from those before it, so that no page takes all."""
        wanted = min(16, max(2, -(-len(places) // PAGE)))
        picks, near = [int(places[0])], self._far(self.points[places[0]], places)
        while len(picks) < wanted and near.max() > 0.0:
            picks.append(int(places[near.argmax()]))
            near = np.minimum(near, self._far(self.points[picks[-1]], places))
        return picks

    def search(self, query: np.ndarray, to_root: float, limit: float, visit) -> None:
        """Best first: ``visit(places)`` gets the vectors that may lie within the limit and returns the new limit."""
        queue = [(to_root - self.reach, 0, self.root, to_root)]
        turn = 0
        while queue:
            least, _, number, here = heapq.heappop(queue)
            if least > limit:
                return
            page = self.pages[number]
            open_ = np.flatnonzero(np.abs(here - page.parent) - page.radius <= limit)
            if not len(open_):
                continue
            if page.leaf:
                limit = visit(page.entries[open_])
                continue
            children = page.entries[open_]
            far = self._far(query, np.array([self.routing[c] for c in children]))
            for child, d, r in zip(children.tolist(), far.tolist(), page.radius[open_].tolist()):
                if d - r <= limit:
                    turn += 1
                    heapq.heappush(queue, (d - r, turn, child, d))


class Unit:
    """One unit of the index: its vectors, their keys and its tree."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, most: float):
        self.vectors, self.keys, self.most = vectors, keys, most
        self.tree = MTree(_augmented(vectors.astype(np.float64), most))

    def __getstate__(self):
        """Without the augmented vectors, which follow from the integer ones."""
        tree = {k: v for k, v in vars(self.tree).items() if k != "points"}
        return self.vectors, self.keys, self.most, tree

    def __setstate__(self, state):
        self.vectors, self.keys, self.most, tree = state
        self.tree = MTree.__new__(MTree)
        vars(self.tree).update(tree, points=_augmented(self.vectors.astype(np.float64), self.most))

    def best(self, query: np.ndarray, key: int, k: int, limit: float) -> list[tuple[int, int]]:
        """The k highest (score, key), ties to the smaller key, without ``key``; none that is farther than the limit."""
        flat = np.append(query.astype(np.float64), 0.0)
        norm = float(flat @ flat)
        slack = SLACK * (self.most + norm**0.5)
        limit += slack
        safe = norm**0.5 * self.most < _SAFE
        held: list[tuple[int, int]] = []  # (score, -key), the worst first

        def visit(places: np.ndarray) -> float:
            nonlocal limit
            scores, others = inner_products(self.vectors[places], query, safe), self.keys[places]
            if len(held) == k:
                high = scores >= held[0][0]
                scores, others = scores[high], others[high]
            for score, other in zip(scores.tolist(), others.tolist()):
                if other == key:
                    continue
                if len(held) < k:
                    heapq.heappush(held, (score, -other))
                elif (score, -other) > held[0]:
                    heapq.heapreplace(held, (score, -other))
            if len(held) == k:
                limit = min(limit, max(norm + self.most**2 - 2.0 * held[0][0], 0.0) ** 0.5 + slack)
            return limit

        root = self.tree.points[self.tree.routing[self.tree.root]]
        gap = root - flat
        self.tree.search(flat, float(gap @ gap) ** 0.5, limit, visit)
        return [(score, -other) for score, other in held]


def _valid(embedding: str) -> Column:
    x = F.col(embedding)
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= HUGE))


def _square(scale: float) -> Column:
    """Squared length of the floors of the scaled vector; a double of 2^53 or more is its own floor."""

    def floor(x: Column) -> Column:
        y = x * F.lit(scale)
        return F.when(F.abs(y) >= 2.0**53, y).otherwise(F.floor(y).cast("double"))

    return F.aggregate("vector", F.lit(0.0), lambda a, x: a + floor(x) * floor(x))


def _rows(lists: pa.Array) -> list[np.ndarray]:
    """The vectors of an Arrow column of lists, without a copy for each component."""
    flat = np.asarray(lists.flatten(), np.float64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def _stack(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    return np.stack([integer_vector(v, scale) for v in vectors])


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(c1, c2, key, vector): of rows alike in vector, the k + 1 of smallest key, which are all that a search can return.

    Rows alike in key too are one; they combine before the shuffle. Of copies under many
    keys each task sends k + 1 at most.
    """
    single = rows.groupBy("c1", "c2", "key").agg(F.first("vector").alias("vector"))
    window = Window.partitionBy("c1", "c2").orderBy("key")
    return single.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k + 1).drop("_rn")


def _pick_pivots(vectors: DataFrame, wanted: int, scale: float) -> dict[int, tuple[np.ndarray, float]]:
    """By number of dimensions: pivots (the vectors of least hash, ``wanted`` at most) and a bound of all norms."""
    width = F.size("vector")
    sizes = vectors.select(width.alias("w"), _square(scale).alias("m")).groupBy("w").agg(F.max("m").alias("m")).collect()
    out = {}
    for row in sizes:
        few = vectors.filter(width == row["w"]).orderBy(F.xxhash64("c1", "c2"), "c1", "c2", "key").limit(wanted)
        flat = np.stack([np.floor(np.array(r[0], np.float64) * scale) for r in few.select("vector").collect()])
        most = row["m"] ** 0.5 * (1 + 1e-9) + 1.0
        out[row["w"]] = (_augmented(flat, most), most)
    return out


def _augmented(flat: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([flat, np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", flat, flat), 0.0))])


def _to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(square - 2.0 * points @ pivots.T, 0.0))


def _by_width(vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for width in np.unique(widths):
        yield int(width), np.flatnonzero(widths == width)


def place_in_cells(vectors: DataFrame, pivots: dict, first: dict[int, int], scale: float) -> DataFrame:
    """Adds the cell of the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            rows = _rows(batch.column(batch.schema.get_field_index("vector")))
            cell, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for width, at in _by_width(rows):
                centres, most = pivots[width]
                far = _to_pivots(_augmented(np.stack([np.floor(rows[i] * scale) for i in at]), most), centres)
                best = far.argmin(axis=1)
                cell[at], gap[at] = first[width] + best, far[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())]))


def build_units(placed: DataFrame, sizes: DataFrame, scale: float, most: dict[int, float], parts: int) -> DataFrame:
    """(unit, cell, tree): every unit's pages in one row; a unit holds about ``UNIT`` vectors at most."""

    def run(batches):
        unit, cell, keys, vectors = None, None, [], []

        def close():
            if vectors:
                width = len(vectors[0])
                built = Unit(_stack(vectors, scale), np.array(keys, np.int64), most[width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit], pa.int64()), pa.array([cell], pa.int64()), pa.array([pickle.dumps(built)], pa.binary())],
                    ["unit", "cell", "tree"],
                )

        for batch in batches:
            names, rows = batch.column(0).to_pylist(), _rows(batch.column(3))
            for name, at, key, row in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), rows):
                if name != unit:
                    yield from close()
                    unit, cell, keys, vectors = name, at, [], []
                keys.append(key)
                vectors.append(row)
        yield from close()

    own = F.pmod(F.xxhash64("c2", "c1", "key"), F.col("units")).cast("int")
    split = placed.join(sizes.select("cell", "units"), "cell").withColumn("unit", F.xxhash64("cell", own))
    dealt = split.select("unit", "cell", "key", "vector").repartition(parts, "unit").sortWithinPartitions("unit", "key")
    return dealt.mapInArrow(run, "unit bigint, cell bigint, tree binary")


def _query_cells(queries: DataFrame, pivots: dict, first: dict[int, int], reach: dict[int, float], scale: float, only_first: bool) -> DataFrame:
    """(cell, query_id, q1, q2, vector, bound): cells that may hold a vector within the bound; the nearest alone, at first."""

    def run(batches):
        for batch in batches:
            rows = _rows(batch.column(3))
            bounds = batch.column(4).to_numpy(zero_copy_only=False)
            out: list[tuple[int, int]] = []
            for width, at in _by_width(rows):
                if width not in pivots:
                    continue
                centres, most = pivots[width]
                flat = np.stack([np.floor(rows[i] * scale) for i in at])
                far = _to_pivots(np.column_stack([flat, np.zeros(len(at))]), centres)
                slack = SLACK * (most + np.sqrt(np.einsum("ij,ij->i", flat, flat)))
                radius = np.array([reach.get(first[width] + j, -1.0) for j in range(len(centres))])
                gap = np.where(radius[None, :] < 0, np.inf, far - radius[None, :])
                if only_first:
                    out += [(int(i), first[width] + int(j)) for i, j in zip(at, np.where(np.isinf(gap), np.inf, far).argmin(axis=1))]
                else:
                    i, j = np.nonzero(~(gap > (bounds[at] + slack)[:, None]))
                    out += [(int(at[a]), first[width] + int(b)) for a, b in zip(i, j) if radius[b] >= 0]
            take = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for _, c in out], pa.int64()), *[batch.column(n).take(take) for n in range(5)]],
                ["cell", *batch.schema.names],
            )

    ordered = queries.select("query_id", "q1", "q2", "vector", "bound")
    return ordered.mapInArrow(run, "cell bigint, query_id bigint, q1 bigint, q2 bigint, vector array<double>, bound double")


def search_units(index: DataFrame, asked: DataFrame, k: int, scale: float, parts: int) -> DataFrame:
    """(query_id, q1, q2, vec_id, score, place): the best of every unit for the queries that visit its cell.

    ``place`` sorts as the true score does; ``score`` is cut to 64 bits.

    The tree of a unit comes first and its queries stream past it, in blocks; units that
    share a cell each get a copy of its queries.
    """

    def run(batches):
        unit, tree = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                out = []
                vectors = _rows(batch.column(5))
                columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)]
                for name, blob, query_id, q1, q2, bound, row in zip(*columns, vectors):
                    if blob is not None:
                        unit, tree = name, pickle.loads(blob)
                    elif name == unit:
                        for score, key in tree.best(integer_vector(row, scale), query_id, k, bound):
                            out.append((query_id, q1, q2, key, max(_LEAST, min(_MOST, score)), sortable(score)))
                if out:
                    kinds = [pa.int64()] * 5 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names = ["query_id", "q1", "q2", "vec_id", "score", "place"]
    none = lambda t: F.lit(None).cast(t)
    trees = index.select(
        "unit", "tree", none("bigint").alias("query_id"), none("bigint").alias("q1"), none("bigint").alias("q2"),
        F.expr("cast(array() as array<double>)").alias("vector"), none("double").alias("bound"),
    )
    visits = asked.join(index.select("unit", "cell"), "cell").select(
        "unit", none("binary").alias("tree"), "query_id", "q1", "q2", "vector", "bound"
    )
    dealt = trees.unionByName(visits).repartition(parts, "unit").sortWithinPartitions("unit", F.col("tree").isNull(), "query_id")
    return dealt.mapInArrow(run, "query_id bigint, q1 bigint, q2 bigint, vec_id bigint, score bigint, place string")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: score descending, then the smaller key."""
    single = found.dropDuplicates(["query_id", "q1", "q2", "vec_id", "place"])
    window = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("place"), "vec_id")
    return single.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def top_inner_products(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10, scale: float = 1024.0
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query, ties to the smaller key.

    Components are floor(scale · x). Queries are the rows whose key ``every`` divides,
    candidates all rows of another key and the same number of dimensions. Null, empty or
    non-finite vectors and rows without a key take no part; a zero vector does. Rows alike
    in key and vector are one; rows that share a key but not the vector are queries of
    their own. With fewer than k candidates all are returned; an empty table has no
    queries. Scores beyond 64 bits rank by their true value and are returned as the end
    of the range. Components of 10^140 or more count as not finite, keys that are no
    integers as null. Other columns are not read. Runs jobs when called.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").try_cast("bigint").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("key").isNotNull() & _valid("vector"))
    rows = store(rows.withColumn("c1", F.xxhash64("vector")).withColumn("c2", F.xxhash64(F.lit(1), "vector")), "rows")
    parts = input_parts(rows)
    known = store(distinct_vectors(rows, k), "vectors")
    pivots = _pick_pivots(known, max(1, min(MOST_PIVOTS, -(-known.count() // CELL))), scale)
    starts = np.cumsum([0, *(len(p) for p, _ in pivots.values())])
    first = {width: int(s) for width, s in zip(pivots, starts)}
    placed = store(place_in_cells(known, pivots, first, scale), "cells")
    cells = placed.groupBy("cell").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    reach = {c["cell"]: c["reach"] for c in cells}
    sizes = spark.createDataFrame([(c["cell"], -(-c["n"] // UNIT)) for c in cells], "cell bigint, units int")
    most = {width: m for width, (_, m) in pivots.items()}
    parts = max(parts, -(-sum(-(-c["n"] // UNIT) for c in cells) // UNITS_A_TASK))
    index = store(build_units(placed, F.broadcast(sizes), scale, most, parts), "index")

    mine = rows.filter(F.pmod("key", F.lit(every)) == 0).dropDuplicates(["key", "c1", "c2"])
    queries = mine.select(F.col("key").alias("query_id"), F.col("c1").alias("q1"), F.col("c2").alias("q2"), "vector")
    queries = store(queries.withColumn("bound", F.lit(float("inf"))), "queries")
    nearest = store(_query_cells(queries, pivots, first, reach, scale, True), "nearest")
    one = store(_merge(search_units(index, nearest, k, scale, parts), k), "first")
    full = one.filter((F.col("rank") == k) & (F.col("score") > _LEAST)).select("query_id", "q1", "q2", F.col("score").cast("double").alias("worst"))
    limited = queries.drop("bound").join(full, ["query_id", "q1", "q2"], "left")
    square = F.coalesce(*[F.when(F.size("vector") == w, F.lit(m * m)) for w, m in most.items()], F.lit(None).cast("double"))
    bound = F.sqrt(F.greatest(_square(scale) + square - 2 * F.col("worst"), F.lit(0.0)))
    limited = limited.withColumn("bound", F.when(F.col("worst").isNull(), F.lit(float("inf"))).otherwise(bound))
    rest = _query_cells(limited, pivots, first, reach, scale, False)
    rest = rest.join(nearest.select("query_id", "q1", "q2", "cell"), ["query_id", "q1", "q2", "cell"], "left_anti")
    best = _merge(one.drop("rank").unionByName(search_units(index, rest, k, scale, parts)), k)
    return best.select("query_id", "rank", "vec_id", "score")
