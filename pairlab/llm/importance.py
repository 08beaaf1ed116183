"""Quality by importance resampling over hashed n-grams.

Two generative models, each a table of feature probabilities, describe the target (the
documents labelled good) and the raw texts (all documents). Features are hashed words
and word pairs, and the shapes of words (case, digits, marks, repetition) and pairs of
shapes. A document's log weight is the log ratio of its probability under the two, and
a sample without replacement is drawn in proportion to the weights by Gumbel top-k.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import Memo, as_bytes, fresh, mix, rows_of, store

#: Slots for words and word pairs, codes of shapes, and slots of all features.
WORD_SLOTS, SHAPES = 1 << 12, 1 << 8
SLOTS = WORD_SLOTS + SHAPES + SHAPES * SHAPES
#: Labelled rows that the target model is fitted on at most; they are broadcast.
MOST_LABELS = 20_000
#: Occurrences that target and raw texts are both taken to have more of every slot.
SMOOTHING = 20.0
#: What a document's log weight may lack by each feature. On the table sf0.01 documents labelled good lack
#: at most 0.001 a feature and those labelled bad 0.88 or more.
PER_FEATURE = 0.1
_RUNS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
_REPEATS = re.compile(rb"(.)\1+")


def word_shape(word: bytes) -> bytes:
    """Runs of capitals, other letters, digits and equal marks, each as one character."""
    for run, letter in _RUNS:
        word = run.sub(lambda m, letter=letter: letter, word)
    return _REPEATS.sub(rb"\1", word)


def _code(word: bytes) -> int:
    """Hash of the lower-cased word; its last seven bits give the shape of the word."""
    return (xxhash.xxh64_intdigest(word.lower()) & ~0xFF) | (xxhash.xxh64_intdigest(word_shape(word)) & 0x7F)


class Features:
    """Feature slots of texts, one for every word, word pair, shape and pair of shapes."""

    def __init__(self, limit: int = 100_000):
        self.memo = Memo(_code, limit)

    def __call__(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, slots of all words and shapes in two rows, slots of all pairs in two rows).

        A pair stands at its second word; the first word of a text has none (-1).
        """
        lists = [text.split() for text in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        codes = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(lists)), np.uint64, total)
        follows = np.ones(total, bool)
        follows[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        shapes = (codes & np.uint64(0x7F)).astype(np.int64)
        shapes[1:] |= ((codes[1:] == codes[:-1]) & follows[1:]).astype(np.int64) << 7
        hashes = codes >> np.uint64(8)
        singles = np.stack([(hashes % np.uint64(WORD_SLOTS)).astype(np.int64), shapes + WORD_SLOTS])
        pairs = np.full((2, total), -1)
        pairs[0, 1:] = mix(hashes[:-1], hashes[1:]) % np.uint64(WORD_SLOTS)
        pairs[1, 1:] = shapes[:-1] * SHAPES + shapes[1:] + (WORD_SLOTS + SHAPES)
        pairs[:, ~follows] = -1
        return sizes, singles, pairs


def portions(texts: Sequence[bytes], most: int = 4 << 20) -> Iterator[Sequence[bytes]]:
    """The texts in order, in runs of about ``most`` bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


@functools.cache
def load_features() -> Features:
    """One memo per worker process."""
    return Features()


def slot_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of every slot in the documents' whole texts. Runs a job; ``SLOTS`` sums reach the driver."""

    def run(batches):
        features, counts = load_features(), np.zeros(SLOTS, np.int64)
        for batch in rows_of(batches):
            for texts in portions(batch.column("text").to_pylist()):
                _, singles, pairs = features(texts)
                counts += np.bincount(singles.ravel(), minlength=SLOTS)
                counts += np.bincount(pairs[pairs >= 0], minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])

    found = docs.select(as_bytes(text).alias("text")).mapInArrow(run, "slot bigint, n bigint")
    counts = np.zeros(SLOTS, np.int64)
    for row in found.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[row["slot"]] = row["n"]
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the slots' probabilities, within the words, the shapes and the pairs of shapes.

    A slot's count in the target is compared with what the raw model expects there; both
    are smoothed, so that slots seen rarely say little.
    """
    out = np.zeros(SLOTS)
    for low, high in ((0, WORD_SLOTS), (WORD_SLOTS, WORD_SLOTS + SHAPES), (WORD_SLOTS + SHAPES, SLOTS)):
        have, all_ = target[low:high], raw[low:high]
        expected = all_ * (have.sum() / max(1, all_.sum()))
        out[low:high] = np.log((have + SMOOTHING) / (expected + SMOOTHING))
    return out


@dataclass(frozen=True)
class ImportanceModel:
    """Log ratio of target and raw probability of every slot."""

    log_ratio: np.ndarray

    def log_weights(self, text: str = "text") -> Column:
        """Struct (log_weight, features) of texts; null and empty texts have weight one and no feature."""
        table = self.log_ratio

        @F.arrow_udf("log_weight double, features bigint")
        def weigh(texts: pa.Array) -> pa.Array:
            sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for some in portions(texts.to_pylist()):
                sizes, singles, pairs = load_features()(some)
                whole = np.append(table[singles].sum(axis=0) + np.where(pairs >= 0, table[pairs], 0.0).sum(axis=0), 0.0)
                each = np.add.reduceat(whole, np.cumsum(sizes) - sizes) if len(sizes) else whole[:0]
                sums.append(np.where(sizes > 0, each, 0.0))
                counts.append(np.maximum(4 * sizes - 2, 0))
            return pa.StructArray.from_arrays([pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts))], ["log_weight", "features"])

        return weigh.asNondeterministic()(as_bytes(text))  # evaluated once, also where it is filtered


def fit_importance(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", good: int = 1) -> ImportanceModel:
    """The model of the good documents against all. Runs jobs.

    The target is fitted on at most ``MOST_LABELS`` labelled rows, those of least hash;
    the raw model covers all documents. Without a good document all weights are one.
    """
    chosen = labels.filter((F.col(label) == good) & F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct()
    chosen = chosen.orderBy(F.xxhash64("__key"), "__key").limit(MOST_LABELS)
    target = slot_counts(docs.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("__key"), "left_semi"), text)
    if not target.any():
        return ImportanceModel(np.zeros(SLOTS))
    return ImportanceModel(log_ratios(target, slot_counts(docs, text)))


def gumbel_key(log_weight: Column, key: Column, seed: int = 11) -> Column:
    """Log weight plus Gumbel noise drawn from the record's key; the k largest are the sample."""
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.round(log_weight - F.log(-F.log(draw)), 6)


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a column of doubles, exactly; none if there are fewer.

    Ranges of values are counted and the one that holds the answer is counted again,
    more finely, until it holds one value; a pass sends at most 4096 counts to the driver.
    """
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or k > n:
        return None
    while low < high:
        step = (high - low) / 4096
        middle = values.filter((F.col(column) >= low) & (F.col(column) <= high))
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(4095)) if step > 0 else F.lit(0)
        bins = middle.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["low"]):
            if row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return low


def allowed(weight: str) -> Column:
    """The log weight with the allowance of every feature: it draws long and short documents alike."""
    return F.col(f"{weight}.log_weight") + F.lit(PER_FEATURE) * F.col(f"{weight}.features")


def _weighed(docs: DataFrame, model: ImportanceModel, key: str, text: str, weight: str, gumbel: str) -> DataFrame:
    found = docs.withColumn(weight, model.log_weights(text))
    return found.withColumn(gumbel, gumbel_key(allowed(weight), F.col(f"`{key}`")))


def _weights(docs: DataFrame, model: ImportanceModel, key: str, text: str) -> DataFrame:
    """(key, log_weight, allowed, gumbel), stored."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = _weighed(slim, model, "key", "text", "weight", "gumbel")
    return store(found.select("key", F.col("weight.log_weight").alias("log_weight"), allowed("weight").alias("allowed"), "gumbel"), "weights")


def _threshold(weights: DataFrame, margin: float) -> float:
    """The least Gumbel key of the sample: as many documents as have an allowed log weight of ``-margin`` or more."""
    k = weights.filter(F.col("allowed") >= -margin).count()
    least = kth_largest(weights, "gumbel", k)
    return float("inf") if least is None else least


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", margin: float = 15.0) -> DataFrame:
    """(key, log_weight, gumbel, kept), one row per document.

    The sample has as many documents as are not ``exp(margin + PER_FEATURE * features)``
    times likelier as raw text than as target, so that length does not decide; Gumbel
    top-k draws it by the log weights with that allowance. Texts without words have log
    weight 0.
    Runs jobs when called.
    """
    weights = _weights(docs, fit_importance(docs, labels, key, text), key, text)
    kept = F.col("gumbel") >= F.lit(_threshold(weights, margin))
    return weights.select(F.col("key").alias(key), "log_weight", "gumbel", kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", margin: float = 15.0) -> DataFrame:
    """All columns of the sampled documents. Weights are computed again rather than joined, so texts are not shuffled."""
    model = fit_importance(docs, labels, key, text)
    least = _threshold(_weights(docs, model, key, text), margin)
    weight, gumbel = fresh(docs, "__log_weight"), fresh(docs, "__gumbel")
    found = _weighed(docs, model, key, text, weight, gumbel).filter(F.col(gumbel) >= F.lit(least))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
