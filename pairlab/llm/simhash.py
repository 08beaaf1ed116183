"""SimHash near-duplicates found with BK-trees.

A fingerprint of 64 bits holds the majority of the hashes of a text's shingles. Two
fingerprints at most ``radius`` bits apart agree on all but ``radius`` of any set of
blocks of bits, so fingerprints are dealt into shards by the blocks they may agree on.
Each shard becomes a BK-tree, whose children are keyed by their distance to the parent;
a search follows only edges within the radius. Shards hold all fingerprints that could
link, so no link is lost, and no tree of all fingerprints exists anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import as_bytes, fresh, has_integer_key, input_parts, on_integer_keys, rows_of, store
from pairlab.llm.components import connected_components

BITS, SEED = 64, 42
#: Fingerprints in one tree; larger shards are cut into trees that are searched by the whole shard.
TREE_SIZE = 512


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; A-Z lower-cased, words joined by a space."""
    found = text.lower().split()
    n = len(found)
    joined = b" ".join(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, 1 if it is set in over half the hashes; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[start : start + (1 << 16)]).view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fingerprint long) of whole texts; a null text is an empty one, whose fingerprint is zero."""

    def run(batches):
        for batch in rows_of(batches):
            prints = [fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), column], ["key", "fingerprint"])

    name = F.col(f"`{key}`").cast("bigint") if has_integer_key(docs, key) else F.col(f"`{key}`")
    source = docs.select(name.alias("key"), as_bytes(text).alias("text"))
    schema = T.StructType([source.schema["key"], T.StructField("fingerprint", T.LongType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


class BKTree:
    """Children by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values within the radius."""
        values, children = self.values, self.children
        todo = [0] if values else []
        while todo:
            place = todo.pop()
            distance = (values[place] ^ value).bit_count()
            if distance <= radius:
                yield place
            low, high = distance - radius, distance + radius
            todo += [child for edge, child in children[place].items() if low <= edge <= high]

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        place = 0
        while place != new:
            distance = (self.values[place] ^ value).bit_count()
            place = self.children[place].setdefault(distance, new)


class Forest:
    """Union-find of the nodes of one shard; linked nodes point at the least one."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, node: int) -> int:
        up = self.up
        while (above := up.get(node, node)) != node:
            up[node] = node = up.get(above, above)
        return node

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[tuple[int, int]]:
        return ((node, self.root(node)) for node in list(self.up))


def shard_links(members: Iterable[tuple[int, int, bool]], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of one shard.

    ``members`` are (node, fingerprint, only_searches): those that only search look
    for links to the others, and come after them.
    """
    tree, nodes, forest = BKTree(), [], Forest()
    for node, value, only_searches in members:
        for place in tree.near(value, radius):
            forest.link(nodes[place], node)
        if not only_searches:
            tree.add(value)
            nodes.append(node)
    return forest.edges()


def _block_bits(blocks: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _shard_keys(print_: Column, radius: int, blocks: int) -> Column:
    keys = []
    for number, chosen in enumerate(combinations(_block_bits(blocks), blocks - radius)):
        parts = [F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << size) - 1)) for low, size in chosen]
        keys.append(F.xxhash64(F.lit(number), *parts))
    return F.array(*keys)


def shard_blocks(prints: int, radius: int, wanted: int = 128) -> int:
    """The fewest blocks whose shards would hold at most ``wanted`` fingerprints if bits were even."""
    blocks = radius + 1
    while prints / 2 ** (BITS * (blocks - radius) / blocks) > wanted and blocks < 2 * radius:
        blocks += 1
    return blocks


def fingerprint_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) edges whose components are those of all pairs within the radius.

    ``prints`` holds (node long, fingerprint long), fingerprints distinct. The pairs of
    a shard are not put out, only a forest over them. A shard beyond ``TREE_SIZE`` is cut
    into chunks by a hash, and every pair of chunks is searched in a task of its own.
    """
    parts = input_parts(prints)
    keys = _shard_keys(F.col("fingerprint"), radius, shard_blocks(prints.count(), radius))
    dealt = prints.select("node", "fingerprint", F.explode(keys).alias("shard"))
    counts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    large = store(counts.filter(F.col("n") > TREE_SIZE).select("shard", F.ceil(F.col("n") / TREE_SIZE).cast("int").alias("chunks")), "shards")
    cut = dealt.join(large, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = cut.withColumn("own", own).withColumn("other", other).select(
        "node",
        "fingerprint",
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        (F.col("own") > F.col("other")).alias("only_searches"),
    )

    def run(batches):
        unit, held, edges = None, [], []
        for batch in batches:
            for node, value, key, late in zip(*(c.to_pylist() for c in batch.columns)):
                if key != unit:
                    edges += shard_links(held, radius)
                    unit, held = key, []
                held.append((node, value & (1 << BITS) - 1, late))
            yield _edge_batch(edges)
            edges = []
        yield _edge_batch([*shard_links(held, radius)])

    placed = paired.repartition(parts, "unit").sortWithinPartitions("unit", "only_searches", "node")
    return placed.mapInArrow(run, "a bigint, b bigint")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([e[side] for e in edges], pa.int64()) for side in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): one row per document.

    ``component_id`` is the smallest key that a document reaches over fingerprints at
    most ``radius`` bits apart, itself included. Equal fingerprints are searched once.
    Documents without words have fingerprint zero and are linked like any other. A row
    without a key links to nothing and has a null component. Keys may have any type with
    an order. Runs jobs when called.
    """
    return on_integer_keys(docs, key, "component_id", lambda rows: _components(rows, key, text, words, radius))


def _components(docs: DataFrame, key: str, text: str, words: int, radius: int) -> DataFrame:
    prints = store(fingerprints(docs, key, text, words), "fingerprints")
    with_key = prints.filter(F.col(key).isNotNull())
    nodes = store(with_key.groupBy("fingerprint").agg(F.min(key).alias("node")), "nodes")
    roots = store(connected_components(fingerprint_links(nodes, radius)), "roots")
    classes = nodes.join(roots, "node", "left").select(
        F.col("fingerprint").alias("print"), F.coalesce("root", "node").alias("component_id")
    )
    classes = store(classes, "classes")
    joined = prints.join(classes, F.col("fingerprint") == F.col("print"), "left")
    return joined.select(
        key,
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _print_of(text: str, words: int) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(shingle_hashes(t, words)) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return run(as_bytes(text))


def keep_first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The documents without those that another one of their component, with a smaller key, stands for.

    A row is judged by its key and fingerprint, so rows of one key whose texts are no near
    copies are apart. Rows without a key stay. Of rows equal in key and fingerprint the
    first by text, then by all columns, stays.
    """
    prints = store(fingerprints(docs, key, text, words), "fingerprints").filter(F.col(key).isNotNull())
    rows = store(prints.groupBy(key, "fingerprint").agg(F.count(F.lit(1)).alias("n")), "rows")
    nodes = store(rows.select(F.col("fingerprint").alias("node"), "fingerprint").distinct(), "nodes")
    roots = store(connected_components(fingerprint_links(nodes, radius)), "roots")
    classes = store(nodes.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("root")), "classes")
    first = rows.join(classes, "fingerprint").groupBy("root").agg(F.min(F.struct(key, "fingerprint")).alias("first"))
    first = store(first.select(F.col(f"first.{key}").alias(key), F.col("first.fingerprint").alias("fingerprint")), "first")
    gone = store(rows.join(first, [key, "fingerprint"], "left_anti").select(key).distinct(), "gone")
    repeated = store(rows.groupBy(key).agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select(key), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, key, "left_anti").select(*docs.columns)
    once = docs.join(gone.unionByName(repeated).distinct(), key, "left_anti").select(*docs.columns)
    print_, place = fresh(docs, "__print"), fresh(docs, "__place")
    again = docs.join(repeated, key, "left_semi").select(*docs.columns).withColumn(print_, _print_of(text, words))
    again = again.join(first.withColumnRenamed("fingerprint", print_), [key, print_], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    of = Window.partitionBy(key, print_).orderBy(F.col(f"`{text}`"), F.to_json(F.struct(*columns)))
    return once.unionByName(again.withColumn(place, F.row_number().over(of)).filter(F.col(place) == 1).select(*columns))
