"""Best-fit packing of token sequences with matching of large pieces.

Only lengths matter for where a piece goes, and a sequence of capacity C knows at most
C lengths. Lengths are therefore counted over all rows, the packing is found on the
counts (bounded by C, whatever the number of rows), and every piece takes the place that
its rank among the pieces of its length has in that plan:

1. pieces above a third of the capacity: the longest is paired with the longest that
   still fits beside it, so at most two of them share a sequence;
2. all others, longest first, go into the tightest gap that takes them, and a new
   sequence is opened where none does.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import as_bytes, input_parts, store

#: The published splitting of the word vocabulary (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters whose class and composed form no Unicode version has changed (fixed value).
USUAL = r"\t-\r\x20-\x7e\xa0-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0482\u048a-\u0527\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
#: Bytes of text whose words are looked up together: repeated words then cost a lookup once.
BATCH = 1 << 22
#: Marks that commonly stand right behind a word.
MARKS = pa.array(list(".,;:!?"), pa.large_string())


class WordTokens:
    """Ids of the tokenizers library for one lower-casing word vocabulary, many texts at a time.

    White space is dropped and words are independent of each other, so texts are split
    here, the distinct words of a batch are looked up in a bounded memo, and the library
    encodes those that the memo lacks, many in one text. Texts with a special token, or
    with a character beyond those whose classes all Unicode versions agree on, go to the
    library whole.
    """

    #: Words that one call of the library takes, and the end of a word's last token.
    JOINED, LAST = 256, "</w>"

    def __init__(self, path: str, memo: int = 440_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import normalizers, pre_tokenizers

        self.path, self.memo = path, memo
        self.words = self._library()
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.special = [t.content for t in self.words.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.words.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.is_last[[number for token, number in vocabulary.items() if token.endswith(self.LAST)]] = True
        usual = regex.compile(rf"[{USUAL}]")
        self.usual = np.array([usual.match(chr(i)) is not None for i in range(1 << 16)])
        self.splitter = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}

    def _library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_padding()
        found.no_truncation()
        return found

    @functools.cached_property
    def whole(self):
        """The library's tokenizer for texts that go to it whole."""
        return self._library()

    def _is_usual(self, text: str) -> bool:
        """No special token, and only usual characters; those beyond 16 bits are none."""
        codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        return bool(self.usual[codes].all()) and not any(s in text for s in self.special)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word. A word's last token says so, which parts words encoded in one text."""
        joined = [words[start : start + self.JOINED] for start in range(0, len(words), self.JOINED)]
        out: list[bytes] = []
        for some, coded in zip(joined, self.words.encode_batch_fast([" ".join(j) for j in joined], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.is_last[ids]) + 1)).tolist()
            if len(stops) == len(some) and stops[-1] == 4 * len(ids):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *stops], stops)]
            else:  # a vocabulary that marks no ends
                one_by_one = self.words.encode_batch_fast(some, add_special_tokens=False)
                out += [np.array(alone.ids, "<u4").tobytes() for alone in one_by_one]
        return out

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words, by a memo of two generations."""
        if len(self.known) >= self.memo:
            self.old_known, self.known = self.known, {}
        known, old = self.known, self.old_known
        found = list(map(known.get, words))
        lacking = [at for at, coded in enumerate(found) if coded is None]
        for at in lacking:
            found[at] = old.pop(words[at], None)
        new = [at for at in lacking if found[at] is None]
        for at, coded in zip(new, self._encode([words[at] for at in new])):
            found[at] = coded
        known.update(zip([words[at] for at in lacking], [found[at] for at in lacking]))
        return found

    def _codes(self, units: pa.Array) -> pa.Array:
        """Packed ids of distinct units (runs without white space).

        Letters alone, and letters with one mark behind them, need no pattern.
        """
        head, mark = pc.utf8_slice_codeunits(units, 0, -1), pc.utf8_slice_codeunits(units, -1)
        alone = pc.utf8_is_alpha(units).to_numpy(zero_copy_only=False)
        marked = pc.and_(pc.is_in(mark, MARKS), pc.utf8_is_alpha(head)).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~(alone | marked))
        patterned = [self.splitter.findall(unit) for unit in units.take(pa.array(others)).to_numpy(zero_copy_only=False)]
        counts = np.where(marked, 2, 1)
        counts[others] = np.fromiter(map(len, patterned), np.int64, len(patterned))
        firsts = np.cumsum(counts) - counts
        rest = pa.array([word for words in patterned for word in words], pa.large_string())
        words = pa.concat_arrays([units.filter(pa.array(alone)), head.filter(pa.array(marked)), mark.filter(pa.array(marked)), rest])
        words = words.dictionary_encode()
        every = np.arange(counts.sum())
        places = [firsts[alone], firsts[marked], firsts[marked] + 1, every[np.repeat(~(alone | marked), counts)]]
        order = np.empty(len(every), np.int64)
        order[np.concatenate(places)] = words.indices.to_numpy()
        coded = pa.array(self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pa.array(order))
        stops = _stops(coded)[np.append(firsts, len(every))]
        return pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(stops), coded.buffers()[2]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        usual = [self._is_usual(text) for text in texts]
        lowered = [text.replace("Σ", "σ").lower() if u else "" for text, u in zip(texts, usual)]
        lists = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        units = lists.flatten().dictionary_encode()
        coded = self._codes(units.dictionary).take(units.indices)
        bounds = _stops(coded)[lists.offsets.to_numpy()].tolist()
        data = memoryview(coded.buffers()[2] or b"")
        out = []
        for text, u, start, stop in zip(texts, usual, bounds, bounds[1:]):
            if u:
                out.append(bytes(data[start:stop]))
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4").tobytes())
        return out


def _stops(coded: pa.Array) -> np.ndarray:
    """Where each value begins in the bytes of a fresh array, and where the last one ends."""
    if not len(coded):
        return np.zeros(1, np.int64)
    return np.frombuffer(coded.buffers()[1], np.int64)[: len(coded) + 1]


def _by_bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + size, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


@functools.cache
def load_words(path: str) -> WordTokens:
    """One tokenizer per worker process and file."""
    return WordTokens(path)


def token_pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1, with_ids: bool = False
) -> DataFrame:
    """(key, piece, start, length, ids_crc32): the ids of each text and an end id, cut only beyond the capacity.

    A null text is an empty one: its only id is the end. ``with_ids`` adds the packed
    ids of the piece. A narrow pass; rows that repeat are packed as often as they occur.
    """
    ending = int(end).to_bytes(4, "little")
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        tokens = load_words(path)
        for batch in _by_bytes(batches, BATCH):
            rows, pieces, lengths, sums, kept = [], [], [], [], []
            texts = [data.decode("utf-8", "replace") for data in batch.column("text").to_pylist()]
            for row, coded in enumerate(tokens(texts)):
                ids = coded + ending
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32())]
            columns += [pa.array([p * capacity for p in pieces], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    source = docs.select(F.col(f"`{key}`").alias("key"), as_bytes(text).alias("text"))
    kinds = [source.schema["key"].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


@dataclass(frozen=True)
class Span:
    """Pieces ``first`` … ``first + count - 1`` of a length go, ``each`` to a sequence, into sequences from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


class _Plan:
    """The packing of counted lengths. Open sequences of one gap are held as ranges of their numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.spans: list[Span] = []
        self.used: dict[int, int] = {}
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def put(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.spans.append(Span(length, self.used.get(length, 0), count, each, sequence, offset))
        self.used[length] = self.used.get(length, 0) + count

    def leave(self, gap: int, sequence: int, number: int) -> None:
        """Note that sequences have this gap left."""
        if gap and number:
            if gap not in self.open:
                self.open[gap] = []
                insort(self.gaps, gap)
            heapq.heappush(self.open[gap], (sequence, number))

    def start(self, number: int) -> int:
        first, self.sequences = self.sequences, self.sequences + number
        return first

    def pair(self, counts: dict[int, int]) -> None:
        """The longest with the longest that fits beside it, until no large piece is left."""
        left = dict(counts)
        sizes = sorted(left)
        while sizes:
            long = sizes[-1]
            at = bisect_left(sizes, self.capacity - long + 1) - 1
            partner = sizes[at] if at >= 0 else None
            if partner is None:
                number = left[long]
                first = self.start(number)
                self.put(long, number, 1, first, 0)
                self.leave(self.capacity - long, first, number)
                left[long] = 0
            elif partner == long:
                number = left[long] // 2
                first = self.start(number)
                self.put(long, 2 * number, 2, first, 0)
                self.leave(self.capacity - 2 * long, first, number)
                left[long] -= 2 * number
                if left[long]:  # one is left over: it takes the next shorter one
                    self._with_shorter(left, sizes[:-1], long)
            else:
                number = min(left[long], left[partner])
                first = self.start(number)
                self.put(long, number, 1, first, 0)
                self.put(partner, number, 1, first, long)
                self.leave(self.capacity - long - partner, first, number)
                left[long] -= number
                left[partner] -= number
            sizes = [s for s in sizes if left[s]]

    def _with_shorter(self, left: dict[int, int], shorter: list[int], long: int) -> None:
        first = self.start(1)
        self.put(long, 1, 1, first, 0)
        left[long] = 0
        gap = self.capacity - long
        if shorter:
            self.put(shorter[-1], 1, 1, first, long)
            left[shorter[-1]] -= 1
            gap -= shorter[-1]
        self.leave(gap, first, 1)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.gaps, length)
            if at == len(self.gaps):
                each = self.capacity // length
                number, rest = divmod(count, each)
                if number:
                    first = self.start(number)
                    self.put(length, number * each, each, first, 0)
                    self.leave(self.capacity - each * length, first, number)
                if rest:
                    first = self.start(1)
                    self.put(length, rest, rest, first, 0)
                    self.leave(self.capacity - rest * length, first, 1)
                return
            gap = self.gaps[at]
            first, number = heapq.heappop(self.open[gap])
            if not self.open[gap]:
                del self.open[gap], self.gaps[at]
            each = gap // length
            full = min(number, count // each)
            if full:
                self.put(length, full * each, each, first, self.capacity - gap)
                self.leave(gap - each * length, first, full)
                count -= full * each
            if full < number:
                first, number = first + full, number - full
                if count:
                    self.put(length, count, count, first, self.capacity - gap)
                    self.leave(gap - count * length, first, 1)
                    first, number, count = first + 1, number - 1, 0
                self.leave(gap, first, number)


def plan_packing(counts: dict[int, int], capacity: int = 4096) -> list[Span]:
    """Spans that place ``counts`` pieces of every length (1 … capacity) into sequences."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must lie in 1 … capacity")
    plan = _Plan(capacity)
    plan.pair({length: n for length, n in counts.items() if n and 3 * length > capacity})
    for length in sorted((k for k, n in counts.items() if n and 3 * k <= capacity), reverse=True):
        plan.best_fit(length, counts[length])
    return plan.spans


def _span_table(spans: list[Span]) -> tuple[np.ndarray, ...]:
    rows = np.array([(s.length, s.first, s.count, s.each, s.sequence, s.offset) for s in spans], np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows, rows[:, 0] * (1 << 44) + rows[:, 1]


def place_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """All columns of the pieces, their ``sequence_id`` and ``offset``. Runs a job when called.

    ``pieces`` (key, piece, length, …) must be a stored frame: it is read twice. Rank
    among equals is counted in slices of a hash, so that a length that very many pieces
    share is not sorted in one task. The plan has one row per run of equal pieces and
    equal gaps, a number that the capacity bounds; it goes to all tasks.
    """
    slices = input_parts(pieces)
    ordered = [c for c in ("piece", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("__slice", F.pmod(F.xxhash64(key, *ordered), F.lit(slices)).cast("int"))
    counts = store(dealt.groupBy("length", "__slice").agg(F.count(F.lit(1)).alias("__n")), "counts")
    spans = plan_packing({int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("__n")).collect()}, capacity)
    table, starts = _span_table(spans)
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    firsts = store(firsts, "firsts")
    within = Window.partitionBy("length", "__slice").orderBy(key, *ordered)
    ranked = (
        dealt.withColumn("__rank", F.row_number().over(within) - 1)
        .join(firsts, ["length", "__slice"])
        .withColumn("__rank", F.col("__rank") + F.col("__first"))
        .select(*pieces.columns, "__rank")
    )

    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            span = table[np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - span[:, 1]
            sequence = span[:, 4] + nth // span[:, 3]
            offset = span[:, 5] + nth % span[:, 3] * length
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(run, T.StructType(fields))


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most ``capacity`` ids.

    Rows repeat as they do in the input; a null key is a key like any other. No
    documents give no rows.
    """
    pieces = store(token_pieces(docs, path, key, text, capacity, end), "pieces")
    return place_pieces(pieces, key, capacity)
