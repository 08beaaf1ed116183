"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and word pairs of the training texts are summed exactly. Each is
quantised to a level, 1 + floor(log2 count), and the filter holds the n-gram once for
every level up to its own; a count is read back by probing level after level until one
is missing. The filter lies in segments, one for each bucket of hashes, that are sized
by the n-grams they hold, so it grows with the texts and no n-gram is left out. Texts
are read in blocks that ask the buckets for their distinct words and pairs; no worker
holds more than a segment at once. Pairs are smoothed with the words' own probabilities:

    P(w | v) = (c(v w) + mu * P(w)) / (c(v) + mu),   P(w) = (c(w) + 1) / (N + V + 1)

Words are named by 64-bit hashes. The word counts of the base score do not come from
the filter: the buckets answer with the exact ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import WordHasher, as_bytes, input_parts, int_crc, mix, rows_of, store

#: The end of a text, counted as a word; a text is read as if one came before it.
END = np.uint64(0xE0D0F7E87)
PROBES, LEVELS = 4, 64
#: Bits of the filter per level held, words at the head of a task's texts that are asked for together,
#: words counted at once in a task, and the weight of the words' own probabilities.
BITS_PER_LEVEL, HEAD, AT_ONCE, MU = 8, 1 << 20, 1 << 21, 2000.0


def words_of(text: bytes, hasher: WordHasher) -> np.ndarray:
    return np.append(hasher(text), END)


def words_before(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each one; the end of a text before the first of the next."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = END
    return before


def pairs_of(words: np.ndarray) -> np.ndarray:
    return mix(words_before(words, np.array([0])), words)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob), dtype=np.uint64)


def _power_of_two(least: int) -> int:
    return 1 << max(0, int(least) - 1).bit_length()


def _unique_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys; the first ``bits`` bits are the bucket."""
    if bits == 0:
        yield 0, 0, len(keys)
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if j > i:
            yield int(bucket[i]), i, j


def _tally(*counts: np.ndarray) -> bytes:
    """[word or pair, level]: how many n-grams and how many occurrences."""
    kinds = [np.bincount(levels_of(x), minlength=LEVELS) for x in counts]
    n = [np.bincount(levels_of(x), weights=x, minlength=LEVELS) for x in counts]
    return np.array([kinds, n]).astype("<i8").tobytes()


def count_ngrams(docs: DataFrame, bits: int, least_pair: int, with_pairs: bool = True) -> DataFrame:
    """(bucket, words, n_words, pairs, n_pairs, bits, tally): sorted hashes, their counts, the filter's segment and its level sums, one row per bucket.

    Scoring needs no pairs beside the filter: without ``with_pairs`` they stay empty.

    ``docs`` holds text as bytes. Tasks count a block of words at a time and hand on the
    distinct ones, so a frequent word travels once per block. Pairs seen fewer than
    ``least_pair`` times in all texts are not handed on after they are summed.
    """

    def count(batches):
        hasher = WordHasher()
        held, size = [], 0

        def out():
            for kind, arrays in (("w", held), ("p", [pairs_of(w) for w in held])):
                keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
                found = list(_by_bucket(keys, bits))
                blobs = [(_pack_sorted(keys[i:j]), _pack(counts[i:j])) for _, i, j in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in found], pa.int64()), pa.array([kind] * len(found)), *(pa.array(c, pa.binary()) for c in zip(*blobs))],
                    ["bucket", "kind", "keys", "counts"],
                )

        for batch in rows_of(batches):
            for text in batch.column("text").to_pylist():
                held.append(words_of(text, hasher))
                size += len(held[-1])
                if size >= AT_ONCE:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def merge(batches):
        names = ["bucket", "words", "n_words", "pairs", "n_pairs", "bits", "tally"]
        bucket, held = None, {"w": ([], []), "p": ([], [])}

        def out():
            sums = {}
            for kind, (keys, counts) in held.items():
                none = np.zeros(0, np.uint64)
                sums[kind] = _unique_sums(np.concatenate([none, *map(_unpack_sorted, keys)]), np.concatenate([none, *map(_unpack, counts)]).astype("<i8"))
                keys.clear()
                counts.clear()
            (w, nw), (p, np_) = sums["w"], sums["p"]
            often = np_ >= least_pair
            p, np_ = p[often], np_[often]
            own = [p.tobytes(), np_.tobytes()] if with_pairs else [b"", b""]
            blobs = [w.tobytes(), nw.tobytes(), *own, segment_of(w, nw, p, np_), _tally(nw, np_)]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names)

        for batch in batches:
            for key, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "counts"))):
                if bucket is not None and key != bucket:
                    yield out()
                bucket = key
                held[kind][0].append(keys)
                held[kind][1].append(counts)
        if bucket is not None:
            yield out()

    blobs = docs.mapInArrow(count, "bucket bigint, kind string, keys binary, counts binary")
    placed = blobs.repartition(max(1, 1 << bits), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(merge, "bucket bigint, words binary, n_words binary, pairs binary, n_pairs binary, bits binary, tally binary")


#: The first bits of a name, all that the filter knows of it: false hits are far more frequent than names alike in them.
SHORT = np.uint64((1 << 64) - (1 << 16))


def _places(keys: np.ndarray, level: int, segment_bits: int) -> Iterator[np.ndarray]:
    for probe in range(PROBES):
        yield mix(keys & SHORT, np.uint64(level * PROBES + probe)) % np.uint64(segment_bits)


def segment_of(words: np.ndarray, n_words: np.ndarray, pairs: np.ndarray, n_pairs: np.ndarray) -> bytes:
    """The bits of one bucket's n-grams, ``BITS_PER_LEVEL`` for each of their levels."""
    held = int(levels_of(n_words).sum() + levels_of(n_pairs).sum())
    flags = np.zeros(max(64, -(-held * BITS_PER_LEVEL // 8) * 8), bool)
    for keys, counts in ((words, n_words), (pairs, n_pairs)):
        tops = levels_of(counts)
        for level in range(1, int(tops.max(initial=0)) + 1):
            for place in _places(keys[tops >= level], level, len(flags)):
                flags[place] = True
    return np.packbits(flags, bitorder="little").tobytes()


def probe_segment(segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The last level, counted from 1, up to which all probes are met."""
    found = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys)) if len(segment) else np.zeros(0, np.int64)
    for level in range(1, LEVELS):
        if not len(alive):
            break
        own = keys[alive]
        met = np.ones(len(own), bool)
        for place in _places(own, level, 8 * len(segment)):
            met &= (segment[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[met]
        found[alive] = level
    return found


@dataclass(frozen=True)
class LogFrequencyFilter:
    """Stored segments; the first bits of an n-gram name its bucket. ``values`` give the mean count of a level."""

    segments: DataFrame
    bucket_bits: int
    word_values: np.ndarray
    pair_values: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The levels of a few keys, whose segments are fetched. Runs a job."""
        bucket = (keys >> np.uint64(64 - self.bucket_bits)).astype(np.int64) if self.bucket_bits else np.zeros(len(keys), np.int64)
        found = np.zeros(len(keys), np.int64)
        for row in self.segments.filter(F.col("bucket").isin(np.unique(bucket).tolist())).select("bucket", "bits").collect():
            own = bucket == row["bucket"]
            found[own] = probe_segment(np.frombuffer(row["bits"], np.uint8), keys[own])
        return found


@dataclass(frozen=True)
class Model:
    filter: LogFrequencyFilter
    tokens: int
    distinct: int
    mu: float


def _level_sums(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """[word or pair, level]: how many n-grams and how many occurrences; 2 x 64 numbers reach the driver."""

    def run(batches):
        for batch in batches:
            tallies = [np.frombuffer(blob, "<i8").reshape(2, 2, LEVELS) for blob in batch.column(0).to_pylist()]
            kinds, n = sum(tallies, np.zeros((2, 2, LEVELS), np.int64))
            where = np.indices(kinds.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (where[0], where[1], kinds.ravel(), n.ravel())], ["kind", "level", "kinds", "n"])

    sums = counts.select("tally").mapInArrow(run, "kind bigint, level bigint, kinds bigint, n bigint")
    kinds, n = np.zeros((2, LEVELS), np.int64), np.zeros((2, LEVELS), np.int64)
    for row in sums.groupBy("kind", "level").agg(F.sum("kinds").alias("kinds"), F.sum("n").alias("n")).collect():
        kinds[row["kind"], row["level"]], n[row["kind"], row["level"]] = row["kinds"], row["n"]
    return kinds, n


def fit_model(docs: DataFrame, text: str = "text", mu: float = MU, least_pair: int = 1, with_pairs: bool = True) -> tuple[Model, DataFrame]:
    """The model of the documents' whole texts, and the stored counts by bucket. Runs jobs."""
    source = docs.select(as_bytes(text).alias("text"))
    bucket_bits = _power_of_two(2 * input_parts(docs)).bit_length() - 1
    counts = store(count_ngrams(source, bucket_bits, least_pair, with_pairs), "ngrams")
    kinds, n = _level_sums(counts)
    values = np.divide(n, kinds, out=np.zeros(n.shape), where=kinds > 0)
    lossy = LogFrequencyFilter(counts.select("bucket", "bits"), bucket_bits, _filled(values[0]), _filled(values[1]))
    return Model(lossy, int(n[0].sum()), int(kinds[0].sum()), mu), counts


def _filled(values: np.ndarray) -> np.ndarray:
    """Levels that no n-gram has read as the middle of their range."""
    middle = np.concatenate([[0.0], 1.5 * 2.0 ** np.arange(LEVELS - 1)])
    return np.where(values > 0, values, middle)


def _pack_words(words: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct words, and the number of each word's; a frequent one's is low."""
    kinds, back, times = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    return kinds[order].tobytes(), _pack(rank[back])


def _unpack_words(kinds: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct words, place of each word among them)."""
    found = np.frombuffer(kinds, "<u8")
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[_unpack(numbers).astype(np.int64)]


def _block_pairs(kinds: np.ndarray, back: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, sorted distinct pairs as the filter knows them, place of each word's pair among them)."""
    starts, words = np.cumsum(sizes) - sizes, kinds[back]
    return starts, *np.unique(mix(words_before(words, starts), words) & SHORT, return_inverse=True)


def _blocks(source: DataFrame, kind: str, head: int) -> DataFrame:
    """(block, keys, held_out, sizes, kinds, numbers): texts one after another, of about ``head`` words a block."""

    def run(batches):
        hasher, block = WordHasher(), TaskContext.get().partitionId() << 33
        keys, outs, texts, size, type_ = [], [], [], 0, None

        def out():
            columns = [pa.array([block], pa.int64()), pa.array([keys], pa.list_(type_)), pa.array([outs], pa.list_(pa.bool_()))]
            blobs = [np.array([len(t) for t in texts], "<i8").tobytes(), *_pack_words(np.concatenate(texts))]
            names = ["block", "keys", "held_out", "sizes", "kinds", "numbers"]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], names)

        for batch in rows_of(batches):
            type_ = batch.column("key").type
            for key, held_out, text in zip(*(batch.column(c).to_pylist() for c in ("key", "held_out", "text"))):
                keys.append(key)
                outs.append(held_out)
                texts.append(words_of(text, hasher))
                size += len(texts[-1])
                if size >= head:
                    yield out()
                    keys, outs, texts, size, block = [], [], [], 0, block + 1
        if texts:
            yield out()

    schema = f"block bigint, keys array<{kind}>, held_out array<boolean>, sizes binary, kinds binary, numbers binary"
    return source.mapInArrow(run, schema)


def _answers(blocks: DataFrame, counts: DataFrame, bucket_bits: int) -> DataFrame:
    """(block, kind, bucket, levels, exact): what the buckets hold of the blocks' distinct words ("w") and pairs ("p"), in their order.

    A block asks a bucket once for each of its n-grams, so a frequent one travels once a block.
    """

    def ask(batches):
        for batch in rows_of(batches, 1):
            block, sizes, kinds, numbers = (batch.column(c)[0].as_py() for c in ("block", "sizes", "kinds", "numbers"))
            sizes = np.frombuffer(sizes, "<i8")
            words, back = _unpack_words(kinds, numbers)
            for kind, keys in (("w", words), ("p", _block_pairs(words, back, sizes)[1])):
                found = list(_by_bucket(keys, bucket_bits))
                columns = [pa.array([b for b, _, _ in found], pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array([kind] * len(found))]
                asked = pa.array([_pack_sorted(keys[i:j]) for _, i, j in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, asked], ["bucket", "block", "kind", "keys"])

    asked = blocks.select("block", "sizes", "kinds", "numbers").mapInArrow(ask, "bucket bigint, block bigint, kind string, keys binary")
    none = F.lit(None).cast("binary")
    known = counts.select("bucket", F.lit(None).cast("bigint").alias("block"), F.lit("").alias("kind"), F.col("words").alias("keys"), "n_words", "bits")
    both = known.unionByName(asked.withColumns({"n_words": none, "bits": none}))

    def answer(batches):
        bucket = words = sums = segment = None
        for batch in batches:
            for part in rows_of([batch], 64):
                rows = []
                for own, block, kind, keys, n_words, bits in zip(*(part.column(c).to_pylist() for c in ("bucket", "block", "kind", "keys", "n_words", "bits"))):
                    if own != bucket:
                        bucket, words, sums, segment = own, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
                    if kind == "":
                        words, sums, segment = np.frombuffer(keys, "<u8"), np.frombuffer(n_words, "<i8"), np.frombuffer(bits, np.uint8)
                        continue
                    asked = _unpack_sorted(keys)
                    exact = _pack(lookup(words, sums, asked)) if kind == "w" else None
                    rows.append((block, kind, bucket, _pack(probe_segment(segment, asked)), exact))
                types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "bucket", "levels", "exact"])

    placed = both.repartition(1 << bucket_bits, "bucket").sortWithinPartitions("bucket", "kind", "block")
    return placed.mapInArrow(answer, "block bigint, kind string, bucket bigint, levels binary, exact binary")


def lookup(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted keys among sorted ones; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def score_texts(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    ``trained`` says which documents are learned from; a null says no. A null or empty
    text holds only its end. Repeated rows are learned from as often as they occur and
    each has its row. Without a document to learn from, N and V are 0. Runs jobs when called.
    """
    learn = F.coalesce(trained, F.lit(False))
    model, counts = fit_model(docs.filter(learn), text, with_pairs=False, **options)
    total, mu = model.tokens + model.distinct + 1, model.mu
    word_values, pair_values = model.filter.word_values, model.filter.pair_values
    source = docs.select(F.col(f"`{key}`").alias("key"), (~learn).alias("held_out"), as_bytes(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    blocks = store(_blocks(source, kind, HEAD), "blocks")  # stored once, so a block keeps its texts
    answers = _answers(blocks, counts, model.filter.bucket_bits)
    both = blocks.withColumn("kind", F.lit("")).unionByName(answers, allowMissingColumns=True)

    def scores(block, levels, exact):
        sizes = np.frombuffer(block["sizes"], "<i8")
        kinds, back = _unpack_words(block["kinds"], block["numbers"])
        starts, _, back_pairs = _block_pairs(kinds, back, sizes)
        level = {k: np.concatenate([_unpack(x) for x in v]).astype(np.int64) for k, v in levels.items()}
        known = np.concatenate([_unpack(x) for x in exact]).astype(np.int64)
        base = np.add.reduceat(np.log10((known + 1.0) / total)[back], starts)
        n_known = np.add.reduceat((known > 0).astype(np.int64)[back], starts)
        held = word_values[level["w"]]
        count, together = held[back], pair_values[level["p"]][back_pairs]
        single = (count + 1.0) / total
        before = words_before(count, starts)
        before[starts] = held[np.searchsorted(kinds, END)]
        together = np.minimum(together, np.minimum(before, count))
        score = np.add.reduceat(np.log10((together + mu * single) / (before + mu)), starts)
        return [block["keys"], block["held_out"], *map(pa.array, (sizes, n_known, base, score))]

    def run(batches):
        block, levels, exact = None, {"w": [], "p": []}, []
        for batch in batches:
            for part in rows_of([batch], 64):
                kinds = part.column("kind").to_pylist()
                for i, kind in enumerate(kinds):
                    if kind == "":
                        if block:
                            yield pa.RecordBatch.from_arrays(scores(block, levels, exact), names)
                        block = {c: part.column(c)[i].as_py() for c in ("sizes", "kinds", "numbers")}
                        block |= {c: part.column(c)[i].values for c in ("keys", "held_out")}
                        levels, exact = {"w": [], "p": []}, []
                        continue
                    levels[kind].append(part.column("levels")[i].as_py())
                    if kind == "w":
                        exact.append(part.column("exact")[i].as_py())
        if block:
            yield pa.RecordBatch.from_arrays(scores(block, levels, exact), names)

    names = ["key", "held_out", "n_tokens", "n_known", "base_score", "score"]
    placed = both.repartition(input_parts(docs), "block").sortWithinPartitions("block", "kind", "bucket")
    scored = placed.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def not_held_out(key: str = "doc_id", modulus: int = 7, fold: int = 2) -> Column:
    return F.pmod(int_crc(F.col(f"`{key}`")), F.lit(modulus)) != fold
