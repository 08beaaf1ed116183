"""Phrases of two and three words that occur together more often than apart, per language.

Words and pairs are counted outright; triples grow from pairs by branch and bound. The
score of a triple is at most a / f(first word) and a / f(last word), where a is no more
than the count of its leading pair and of its trailing pair, so pair counts bound every
triple that could grow from them. A wave opens the best of the frontier: for a level T,
all triples whose two bounds reach T, and all that touch a pair scored T or more (they
decide whether that pair survives). After a wave everything that scores T or more is
known; a language whose wanted number of survivors is reached is settled, with all ties,
and T falls for the others until their frontier is empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import Memo, as_bytes, rows_of, store

#: Scores are parts per million.
SCALE = 1_000_000
#: Tokens counted together in one task, bytes of a text taken at once, hashes remembered, and slots of the frontier's table.
CHUNK, SEGMENT, MEMO, SLOTS = 1 << 19, 1 << 20, 100_000, 1 << 22
#: The first wave opens this many times the wanted number of pairs, and each later wave so many times more.
FIRST_WAVE, WIDER = 2, 8
#: What a pair may be: frequent, leading a triple, trailing one, or in question itself.
FREQUENT, LEADS, TRAILS, ASKED = 1, 2, 4, 8

_MARK = b"."
_SAME = bytes(_MARK[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b in b" \t" else b for b in range(256))


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, ``.`` where a piece ends; a long text comes in several lists."""
    text = text.lower().translate(_SAME)
    start = 0
    while start < len(text):
        end = start + SEGMENT
        if end < len(text):
            gap = text.find(b" ", end)
            end = len(text) if gap < 0 else gap
        yield text[start:end].replace(_MARK, b" . ").split()
        start = end


def _hashed(memo: Memo, tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


class _Buffer:
    """Hashed words of one language, counted when enough have come."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.carried = 0

    def take(self, size: int) -> tuple[np.ndarray, int]:
        """All hashes, and how many of them were there before; the last ``size - 1`` stay for grams that go on."""
        whole = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        old, left = self.carried, whole[max(0, len(whole) - size + 1) :]
        self.parts, self.carried = [left], len(left)
        return whole, old


def _grams(words: np.ndarray, old: int, size: int, mark: np.uint64) -> np.ndarray:
    """(grams, size) of the runs of words without a mark that end after the first ``old`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros((0, size), np.uint64)
    clean = words != mark
    keep = clean[:n].copy()
    for i in range(1, size):
        keep &= clean[i : i + n]
    keep[: max(0, old - size + 1)] = False
    at = np.flatnonzero(keep)
    return np.stack([words[at + i] for i in range(size)], axis=1)


def _count(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    order = np.lexsort(grams.T[::-1])
    grams = grams[order]
    new = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]).any(axis=1)])
    return grams[new], np.diff(np.r_[new, len(grams)])


def _pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs of words in the frontier's table; ``_slot`` is the same in SQL functions."""
    return ((a * np.uint64(0x9E3779B97F4A7C15)) ^ b) & np.uint64(SLOTS - 1)


def _slot(a: str, b: str) -> Column:
    """Low bits of a product are those of the product of low bits, so that nothing overflows."""
    low = F.lit(SLOTS - 1).cast("bigint")
    product = F.col(a).bitwiseAND(low) * F.lit(0x9E3779B97F4A7C15 & (SLOTS - 1)).cast("bigint")
    return product.bitwiseXOR(F.col(b)).bitwiseAND(low)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    group = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    return docs.select(as_bytes(text).alias("text"), group.alias("lang"))


def count_words_and_pairs(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1, w2, word, n): counts of words (``w2`` null) and of pairs (``word`` null); words by their 64-bit hashes."""

    def run(batches):
        memo = Memo(xxhash.xxh64_intdigest, MEMO)
        mark = np.uint64(memo[_MARK])
        buffers: dict[str, _Buffer] = {}
        words: dict[str, Counter] = {}
        held = 0

        def flush():
            for name, buffer in buffers.items():
                count = words.pop(name, Counter())
                count.pop(_MARK, None)
                if count:
                    n, hashes = len(count), _hashed(memo, list(count)).view(np.int64)
                    own = [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(hashes), pa.nulls(n, pa.int64()), *own], names)
                pairs, found = _count(_grams(*buffer.take(2), 2, mark))
                n = len(pairs)
                if n:
                    columns = [np.ascontiguousarray(pairs[:, i]).view(np.int64) for i in range(2)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(columns[0]), pa.array(columns[1]), pa.nulls(n, pa.binary()), pa.array(found)], names
                    )

        for batch in rows_of(batches):
            for text_, name in zip(batch.column(0), batch.column(1).to_pylist()):
                buffer = buffers.setdefault(name, _Buffer())
                for tokens in _segments(text_.as_py()):
                    words.setdefault(name, Counter()).update(tokens)
                    buffer.parts.append(_hashed(memo, tokens))
                    held += len(tokens)
                    if held >= CHUNK:
                        yield from flush()
                        held = 0
                buffer.parts.append(np.array([mark]))
        yield from flush()

    names = ["lang", "w1", "w2", "word", "n"]
    partial = _texts(docs, text, lang).mapInArrow(run, "lang string, w1 bigint, w2 bigint, word binary, n bigint")
    return partial.groupBy("lang", "w1", "w2", "word").agg(F.sum("n").alias("n"))


def frontier_table(pairs: DataFrame) -> np.ndarray:
    """A byte for each slot with the roles of all pairs that fall there; sixteen slots reach the driver as one number.

    The table has ``SLOTS`` bytes at every size. A pair that shares a slot seems to have
    roles that it lacks; then triples are counted that nobody asked for, and rightly so.
    """
    slots = pairs.select(_slot("w1", "w2").alias("slot"), F.col("role").cast("bigint").alias("role"))
    packed = slots.groupBy((F.shiftright("slot", 4)).cast("int").alias("place"))
    found = packed.agg(F.expr("bit_or(shiftleft(role, cast(4 * (slot & 15) AS int)))").alias("roles")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    places, roles = (found.column(c).to_numpy() for c in ("place", "roles"))
    for i in range(16):
        table[places.astype(np.int64) * 16 + i] = roles.view(np.uint64) >> np.uint64(4 * i) & np.uint64(15)
    return table


def count_triples(texts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, w3, n): triples of (text, lang) that the roles of pairs (w1, w2, role) open and that occur often enough."""
    shared = texts.sparkSession.sparkContext.broadcast(frontier_table(pairs))

    def run(batches):
        memo = Memo(xxhash.xxh64_intdigest, MEMO)
        mark = np.uint64(memo[_MARK])
        buffers: dict[str, _Buffer] = {}
        held = 0

        def flush():
            for name, buffer in buffers.items():
                whole, old = buffer.take(3)
                if len(whole) < 3:
                    continue
                roles = shared.value[_pair_slots(whole[:-1], whole[1:])]
                lead, trail = roles[:-1], roles[1:]
                both = (lead & FREQUENT & trail).astype(bool)
                open_ = both & (((lead & LEADS) > 0) & ((trail & TRAILS) > 0) | (((lead | trail) & ASKED) > 0))
                clean = whole != mark
                open_ &= clean[:-2] & clean[1:-1] & clean[2:]
                open_[: max(0, old - 2)] = False
                at = np.flatnonzero(open_)
                triples, found = _count(np.stack([whole[at + i] for i in range(3)], axis=1))
                if len(triples):
                    columns = [pa.array(np.ascontiguousarray(triples[:, i]).view(np.int64)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(triples)), *columns, pa.array(found)], names)

        for batch in rows_of(batches):
            for text_, name in zip(batch.column(0), batch.column(1).to_pylist()):
                buffer = buffers.setdefault(name, _Buffer())
                for tokens in _segments(text_.as_py()):
                    buffer.parts.append(_hashed(memo, tokens))
                    held += len(tokens)
                    if held >= CHUNK:
                        yield from flush()
                        held = 0
                buffer.parts.append(np.array([mark]))
        yield from flush()

    names = ["lang", "w1", "w2", "w3", "n"]
    partial = texts.mapInArrow(run, "lang string, w1 bigint, w2 bigint, w3 bigint, n bigint")
    return partial.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _parts_of(whole: Column, left: Column, right: Column) -> Column:
    """floor(SCALE · whole² / (left · right)) in decimals, which hold 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (whole, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(32,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))


def score_pairs(grams: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, pairs): words with their counts; pairs that occur often enough, with score and bounds."""
    words = grams.filter(F.col("w2").isNull()).select("lang", F.col("w1").alias("w"), "word", "n")
    pairs = grams.filter(F.col("w2").isNotNull() & (F.col("n") >= least)).select("lang", "w1", "w2", F.col("n").alias("a"))
    often = words.filter(F.col("n") >= least)
    for side in ("1", "2"):
        count = often.select("lang", F.col("w").alias(f"w{side}"), F.col("n").alias(f"f{side}"))
        pairs = pairs.join(count, ["lang", f"w{side}"])
    bound = lambda f: F.least(F.lit(SCALE), F.call_function("div", F.col("a").cast("decimal(19,0)") * SCALE, F.col(f).cast("decimal(19,0)")))
    return words, pairs.select(
        "lang", "w1", "w2", "a", "f1", "f2",
        _parts_of(F.col("a"), F.col("f1"), F.col("f2")).alias("score"),
        bound("f1").alias("leading"),
        bound("f2").alias("trailing"),
    )


def _score_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with the counts of their pairs and words, the lower-scoring cut first (ties: the first cut)."""
    lead = pairs.select("lang", "w1", "w2", F.col("a").alias("a12"), "f1")
    trail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3"))
    known = triples.withColumnRenamed("n", "a").join(lead, ["lang", "w1", "w2"]).join(trail, ["lang", "w2", "w3"])
    cut1, cut2 = _parts_of(F.col("a"), F.col("f1"), F.col("a23")), _parts_of(F.col("a"), F.col("a12"), F.col("f3"))
    first = cut1 <= cut2
    return known.select(
        "lang", "w1", "w2", "w3", "a", "a12", "a23",
        F.when(first, F.col("f1")).otherwise(F.col("a12")).alias("l"),
        F.when(first, F.col("a23")).otherwise(F.col("f3")).alias("r"),
        F.when(first, cut1).otherwise(cut2).alias("score"),
    )


def _roles(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """Pairs of the open languages with their roles at the level T of their language; languages come in a stored table."""
    t = F.col("t")
    role = (
        F.lit(FREQUENT)
        + F.when(F.col("leading") >= t, LEADS).otherwise(0)
        + F.when(F.col("trailing") >= t, TRAILS).otherwise(0)
        + F.when(F.col("score") >= t, ASKED).otherwise(0)
    )
    return pairs.join(levels, "lang").withColumn("role", role)


def _nth(df: DataFrame, n: int, order: list[Column], columns: list[str]) -> DataFrame:
    """The n-th row per language in an order; languages with fewer rows have none."""
    window = Window.partitionBy("lang").orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    return ranked.filter(F.col("_rn") == n).select("lang", *columns)


def _wave(texts: DataFrame, pairs: DataFrame, levels: DataFrame, least: int, share: int) -> DataFrame:
    """All surviving phrases of the open languages that score their level or more."""
    asked = _roles(pairs, levels)
    scored = store(_score_triples(count_triples(texts, asked, least), asked), "triples")
    touch = scored.select("lang", "w1", "w2", F.col("a").alias("n"), F.col("a12").alias("own")).union(scored.select("lang", "w2", "w3", "a", "a23"))
    heavy = F.col("n").cast("decimal(19,0)") * 100 >= F.col("own").cast("decimal(19,0)") * share
    covered = touch.filter(heavy).select("lang", "w1", "w2").distinct()
    columns = ["lang", "w1", "w2", "w3", "a", "l", "r", "score"]
    alone = asked.filter(F.col("score") >= F.col("t")).join(covered, ["lang", "w1", "w2"], "left_anti")
    short = alone.select("lang", "w1", "w2", F.lit(None).cast("bigint").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    grown = scored.join(levels, "lang").filter(F.col("score") >= F.col("t")).select(columns)
    return short.unionByName(grown)


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, best: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of two or three words per language.

    A is lower-cased to a, through Z; pieces end at ``.,;:!?`` and line ends, words at
    blanks and tabs. A phrase that occurs ``least`` times or more is a candidate; it is
    dropped if ``share`` percent of its occurrences or more lie in one longer candidate.
    The score is floor(10^6 · a² / (l · r)) at the cut that makes it least (ties: the
    first). Ranks go by score, count (descending) and the phrase bytewise.

    Null and empty texts hold no words; a null language is ``und``; repeated rows count
    again; long texts are read in segments that lose no phrase; an empty table has no
    phrases. Other columns are not read. Counts to 10^16 are exact. Words are named by
    64-bit hashes. Runs jobs when called: one pass over the texts, and one for each wave.
    """
    grams = store(count_words_and_pairs(docs, text, lang).filter(F.col("w2").isNull() | (F.col("n") >= least)), "grams")
    words, scored_pairs = score_pairs(grams, least)
    pairs = store(scored_pairs, "pairs")
    totals = store(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    order = [F.desc("score"), F.desc("a"), F.col("w1"), F.col("w2")]
    open_, opened, results, texts = totals.select("lang"), FIRST_WAVE * best, [], _texts(docs, text, lang)
    while True:
        at = _nth(pairs, opened, order, ["score"]).withColumnRenamed("score", "t")
        levels = store(open_.join(at, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).alias("t")), "levels")
        found = store(_wave(texts, pairs, levels, least, share), "survivors")
        counts = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = store(levels.join(counts, "lang", "left"), "state")
        settled = (F.coalesce("found", F.lit(0)) >= best) | (F.col("t") <= 0)
        results.append(found.join(state.filter(settled).select("lang"), "lang", "left_semi"))
        open_, opened = state.filter(~settled).select("lang"), opened * WIDER
        if open_.isEmpty():
            break
        texts = _texts(docs, text, lang).join(open_, "lang", "left_semi").select("text", "lang")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    border = _nth(whole, best, [F.desc("score"), F.desc("a")], ["score", "a"])
    border = store(border.select("lang", F.col("score").alias("_score"), F.col("a").alias("_a")), "border")
    near = whole.join(border, "lang", "left").filter(
        F.col("_score").isNull() | (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("a") >= F.col("_a")))
    )
    for i in ("1", "2", "3"):
        name = words.select("lang", F.col("w").alias(f"w{i}"), F.col("word").cast("string").alias(f"s{i}"))
        near = near.join(name, ["lang", f"w{i}"], "left")
    named = near.withColumn("phrase", F.concat_ws(" ", "s1", "s2", "s3")).select("lang", "phrase", "a", "l", "r", "score")
    last = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*last)).cast("bigint"))
    return ranked.filter(F.col("rank") <= best).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
