"""Language identification by rank-order profiles.

The most frequent character n-grams of a text, in order of frequency, are compared with
those of each language. The distance is the sum of how far each n-gram is out of its
place in the profile; one that the profile lacks counts as the length of the profile.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import as_bytes, fresh, int_crc, rows_of, store

#: Bits of a code point; up to three of them fill a 64-bit integer.
POINT_BITS = 21
PROFILE, SPACE, UNKNOWN = 300, 32, "und"
#: Distinct n-grams of one language that a task holds before it hands them on.
HELD = 1 << 20


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form (one character or itself), and whether that is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        small = chr(point).lower()
        if len(small) == 1:
            lower[point] = ord(small)
        letter[point] = chr(point).isalpha()
    return lower, letter


def letter_grams(text: bytes) -> np.ndarray:
    """All 1- to 3-grams of the words of a text; words end in a space on both sides, no n-gram has one inside."""
    lower, letter = _characters()
    points = lower[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    is_letter = letter[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.where(is_letter, points, SPACE).astype(np.int64)
    edge = np.concatenate([[True], ~is_letter[:-1]])
    kept = np.flatnonzero(is_letter | ~edge)  # one space between words
    points = np.concatenate([[SPACE], points[kept], [SPACE]])
    if points[-2] == SPACE:
        points = points[:-1]
    if points[1] == SPACE:
        points = points[1:]
    inner = points != SPACE
    two = points[:-1] << POINT_BITS | points[1:]
    three = (two[:-1] << POINT_BITS | points[2:])[inner[1:-1]]
    return np.concatenate([points[inner], two, three])


def ranked_grams(text: bytes, length: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order; equally frequent ones by their code."""
    grams, counts = np.unique(letter_grams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:length]]


@dataclass(frozen=True)
class Profiles:
    """Languages, all n-grams of their profiles in order, and each one's place in every language (or the length)."""

    languages: tuple[str, ...]
    grams: np.ndarray
    places: np.ndarray
    length: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], length: int = PROFILE) -> Profiles:
        languages = tuple(sorted(ranked))
        grams = np.unique(np.array([g for l in languages for g in ranked[l]], np.int64))
        places = np.full((len(languages), len(grams) + 1), length, np.int64)  # the last column: in no profile
        for row, language in enumerate(languages):
            places[row, np.searchsorted(grams, ranked[language])] = np.arange(len(ranked[language]))
        return cls(languages, grams, places, length)

    def predict(self, text: bytes) -> tuple[str, float]:
        """The nearest language and one minus its share of the largest distance; ties go to the first name."""
        own = ranked_grams(text, self.length)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        found = self.places[:, np.where(known, at, len(self.grams))]
        missing = found == self.length
        far = np.where(missing, self.length, np.abs(found - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return self.languages[best], float(1.0 - far[best] / (self.length * len(own)))


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = PROFILE) -> Profiles:
    """Profiles of all non-null languages from the whole texts of the given documents. Runs jobs.

    n-grams are counted in each task, summed over all, and only the most frequent of
    each language and slice of the n-grams reach the driver: 8 x ``length`` at most.
    """

    def run(batches):
        held: dict[str, dict[int, int]] = {}

        def out(language):
            counts = held.pop(language)
            grams = pa.array(np.fromiter(counts, np.int64, len(counts)))
            numbers = pa.array(np.fromiter(counts.values(), np.int64, len(counts)))
            return pa.RecordBatch.from_arrays([pa.array([language] * len(counts)), grams, numbers], ["lang", "gram", "n"])

        for batch in rows_of(batches, 256):
            languages, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for language in set(languages):
                own = [letter_grams(t) for t, l in zip(texts, languages) if l == language]
                grams, counts = np.unique(np.concatenate(own), return_counts=True)
                sums = held.setdefault(language, {})
                for gram, n in zip(grams.tolist(), counts.tolist()):
                    sums[gram] = sums.get(gram, 0) + n
                if len(sums) > HELD:
                    yield out(language)
        for language in list(held):
            yield out(language)

    source = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), as_bytes(text).alias("text"))
    counts = source.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("gram"), F.lit(8))
    best = Window.partitionBy("lang", part).orderBy(F.desc("n"), "gram")
    top = store(counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= length), "profiles")
    ranked: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "gram", "n").collect():
        ranked.setdefault(row["lang"], []).append((-row["n"], row["gram"]))
    return Profiles.of({l: [g for _, g in sorted(rows)[:length]] for l, rows in ranked.items()}, length)


def predicted_language(profiles: Profiles, text: str = "text") -> Column:
    """Struct (lang, score): the predicted language of a text; ``und`` and 0 for a null or a text without a letter."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t) for t in texts.to_pylist()]
        names, scores = (list(x) for x in zip(*found)) if found else ([], [])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict.asNondeterministic()(as_bytes(text))  # evaluated once, also where the result is filtered


def held_out(key: str = "doc_id", modulus: int = 4, fold: int = 2) -> Column:
    """Whether a document is not learned from; one without a key never is."""
    return F.coalesce(F.pmod(int_crc(F.col(f"`{key}`")), F.lit(modulus)) == fold, F.lit(True))


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score), one row per document; profiles come from the documents not held out."""
    profiles = fit_profiles(docs.filter(~held_out(key)), text, lang)
    with_prediction = docs.select(F.col(f"`{key}`").alias(key), held_out(key).alias("held_out"), predicted_language(profiles, text).alias("p"))
    return with_prediction.select(key, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.05) -> DataFrame:
    """All columns of the documents with a letter whose nearest profile shares at least ``least`` of their order."""
    profiles = fit_profiles(docs.filter(~held_out(key)), text, lang)
    column = fresh(docs, "__language")
    found = docs.withColumn(column, predicted_language(profiles, text))
    kept = (F.col(f"{column}.lang") != UNKNOWN) & (F.col(f"{column}.score") >= least)
    return found.filter(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
