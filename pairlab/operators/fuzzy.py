"""Best fuzzy match per name without comparing every name with every choice.

Two strings whose edit distance is at most ``(1 - c)`` of the longer length share
at least ``(2c - 1) * length + 1`` of their padded bigrams, because one edit touches
two bigrams. Sorting each string's bigrams by rarity, the pair must then meet in
the first ``length + 1 - ceil((2c - 1) * length)`` of them. Joining on those
prefixes finds every pair at or above the cut-off and seldom joins on a common
bigram; nothing is capped or sampled.

Where an alphabet is small, many names make every bigram common. Two of ``k + 2``
segments of a choice also survive ``k`` edits: the pair then meets in the letters of two
segments, six or more for most names. Names with long parts in common share segments
instead, so the pairs of both ways are counted, by key, and the lesser way is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.similarity import (
    FAR_FROM,
    FAR_SCALE,
    PARTIAL_FROM,
    PARTIAL_SCALE,
    SHARED_WORD_SCORE,
    TOKEN_SCALE,
    weighted_similarity,
)
from pairlab.operators.ranking import first_per_key
from pairlab.session import cut_lineage

_SLACK = 1e-9
#: Pairs for each name at most that are joined without looking for a lesser way.
FEW = 32


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def edit_similarity(a: Column, b: Column) -> Column:
    """0…100: share of the longer string that edits leave untouched."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.try_divide((longest - F.levenshtein(a, b)) * F.lit(100.0), longest)


def name_similarity(a: Column, b: Column) -> Column:
    """Better of the plain and the word-order-free edit similarity."""
    return F.greatest(edit_similarity(a, b), edit_similarity(sort_tokens(a), sort_tokens(b)))


def _bigrams(text: Column) -> Column:
    """Padded bigrams, numbered so that repeats differ."""
    padded = F.concat(F.lit("\u0001"), text, F.lit("\u0002"))
    grams = F.transform(
        F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(2))
    )
    return F.transform(
        grams,
        lambda g, i: F.concat(
            g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda other: other == g)).cast("string")
        ),
    )


def _grams(df: DataFrame, key: str) -> DataFrame:
    """One row per bigram of the plain text (channel 0) and of its sorted words (1)."""
    texts = F.array(F.col(key), sort_tokens(F.col(key)))
    spelled = df.select(key, F.posexplode(texts).alias("channel", "_text"))
    return spelled.select(
        key,
        "channel",
        F.length("_text").cast("int").alias("len"),
        F.explode(_bigrams(F.col("_text"))).alias("gram"),
    )


def _counts(grams: DataFrame, *keys: str) -> DataFrame:
    """How common each item is, stored: a small table is then broadcast to the items."""
    return cut_lineage(grams.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "counts")


def _prefixes(grams: DataFrame, frequency: DataFrame, key: str, cutoff: float) -> DataFrame:
    """The rarest bigrams of each string, as many as the cut-off calls for."""
    keep = F.col("len") + 1 - F.ceil(F.lit((2 * cutoff - 100) / 100) * F.col("len") - F.lit(_SLACK))
    window = Window.partitionBy(key, "channel").orderBy(F.coalesce(F.col("n"), F.lit(0)), "gram")
    return (
        grams.join(frequency, ["channel", "gram"], "left")
        .withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= keep)
        .select(key, "channel", "len", "gram")
    )


def _by_bigrams(names: DataFrame, choices: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame, list[str]]:
    left, right = _grams(names, "name_key"), _grams(choices, "choice_key")
    frequency = _counts(right, "channel", "gram")
    a = _prefixes(left, frequency, "name_key", cutoff)
    b = _prefixes(right, frequency, "choice_key", cutoff).withColumnRenamed("len", "len_b")
    return a, b, ["channel", "gram"]


def _near(cutoff: float) -> Column:
    longest = F.greatest("len", "len_b")
    return F.abs(F.col("len") - F.col("len_b")) <= F.lit((100 - cutoff) / 100) * longest + F.lit(_SLACK)


def _segments(sizes: DataFrame, cutoff: float) -> DataFrame:
    """(len_b, i, j, at_i, at_j, long_i, long_j): any two segments of a choice of that length.

    There are two more segments than edits that a name near such a choice can have.
    """
    c = cutoff / 100
    most = F.floor(F.lit((1 - c) / c) * F.col("len_b") + F.lit(1e-6)).cast("int")
    start = lambda i: F.floor(i * F.col("len_b") / F.col("m")).cast("int")
    pairs = (
        sizes.withColumn("m", most + 2)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 2)))
        .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("m") - 1)))
    )
    ends = [start(F.col(x)).alias(f"at_{x}") for x in ("i", "j")]
    spans = [(start(F.col(x) + 1) - start(F.col(x))).alias(f"long_{x}") for x in ("i", "j")]
    return pairs.select("len_b", "i", "j", *ends, *spans)


def _places(lengths: DataFrame, segments: DataFrame, cutoff: float) -> DataFrame:
    """Where the segments of a choice, of length ``len_b``, may lie in a name of length ``len``.

    Segments shifted by s and t need |s| edits before the first, |t - s| between them and
    |d - t| behind them, d the difference in length.
    """
    k = F.floor(F.lit(1 - cutoff / 100) * F.greatest("len", "len_b") + F.lit(_SLACK)).cast("int")
    s, t, d = F.col("s"), F.col("t"), F.col("len") - F.col("len_b")
    moved = (
        lengths.filter(_near(cutoff))
        .join(segments, "len_b")
        .withColumn("k", k)
        .withColumn("s", F.explode(F.sequence(-F.col("k"), F.col("k"))))
        .filter(F.abs(s) + F.abs(d - s) <= F.col("k"))
        .withColumn("t", F.explode(F.sequence(-F.col("k"), F.col("k"))))
        .filter(F.abs(s) + F.abs(t - s) + F.abs(d - t) <= F.col("k"))
        .withColumns({"at_i": F.col("at_i") + s, "at_j": F.col("at_j") + t})
    )
    inside = [(F.col(f"at_{x}") >= 0) & (F.col(f"at_{x}") + F.col(f"long_{x}") <= F.col("len")) for x in ("i", "j")]
    return moved.filter(inside[0] & inside[1]).select("len", *segments.columns)


def _by_segments(names: DataFrame, choices: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame, list[str]]:
    def keyed(df: DataFrame, places: DataFrame, key: str) -> DataFrame:
        spelled = F.array(F.col(key), sort_tokens(F.col(key)))
        texts = df.select(key, F.length(key).alias("len"), F.posexplode(spelled).alias("channel", "_text"))
        pieces = [F.substring(F.col("_text"), F.col(f"at_{x}") + 1, F.col(f"long_{x}")) for x in ("i", "j")]
        met = texts.join(places, "len")
        return met.select(key, F.xxhash64("channel", "len_b", "i", "j", *pieces).alias("segments"))

    sizes = choices.select(F.length("choice_key").alias("len_b")).distinct()
    lengths = names.select(F.length("name_key").alias("len")).distinct().crossJoin(sizes)
    segments = cut_lineage(_segments(sizes, cutoff), "segments")
    places = cut_lineage(_places(lengths, segments, cutoff), "places")
    return (
        keyed(names, places, "name_key"),
        keyed(choices, segments.withColumn("len", F.col("len_b")), "choice_key"),
        ["segments"],
    )


def _pairs_met(a: DataFrame, b: DataFrame, keys: list[str]) -> int:
    """Rows that the join on the keys would have."""
    one, two = (df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in ((a, "_n"), (b, "_m")))
    return one.join(two, keys).agg(F.sum(F.col("_n") * F.col("_m"))).head()[0] or 0.0


def edit_candidates(names: DataFrame, choices: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (name_key, choice_key) that may reach ``cutoff``; every pair that does is among them.

    ``names`` has a distinct ``name_key``, ``choices`` a distinct ``choice_key``.
    """
    if cutoff <= 50:
        raise ValueError("the prefix bound needs a cut-off above 50")
    a, b, keys = _by_segments(names, choices, cutoff)
    met = _pairs_met(a, b, keys)
    if met > FEW * names.count():
        grams = _by_bigrams(names, choices, cutoff)
        if _pairs_met(*grams) < met:
            a, b, keys = grams
    pairs = a.join(b, keys)
    return (pairs.filter(_near(cutoff)) if "gram" in keys else pairs).select("name_key", "choice_key").distinct()


def _word_texts(c: Column) -> Column:
    """The text, its words sorted, and its distinct words sorted."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.array_distinct(
        F.array(c, F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " "))
    )


def _rarest(
    grams: DataFrame, frequency: DataFrame, keys: list[str], keep: Column, item: str = "gram"
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.coalesce(F.col("n"), F.lit(0)), item)
    return (
        grams.join(frequency, item, "left")
        .withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") <= keep)
    )


def _alike_candidates(left: DataFrame, right: DataFrame, c: float) -> DataFrame:
    """Pairs whose plain, word-sorted or word-set ratio may reach c (0…1).

    Padding with the word separator makes the bigrams of a text independent of
    the order of its words. Of lengths l and m at ratio c, d = (1 - c)(l + m)
    characters are unmatched, the matched ones fall into at most d + 1 runs, and
    m ≥ l c / (2 - c); so (1.5 c - 1) 2 l / (2 - c) + 1 bigrams are shared.
    """

    def explode(df: DataFrame, key: str) -> DataFrame:
        texts = df.select(key, F.explode(_word_texts(F.col(key))).alias("_text"))
        padded = F.concat(F.lit(" "), F.col("_text"), F.lit(" "))
        grams = F.transform(
            F.sequence(F.lit(1), F.length("_text") + 1), lambda i: F.substring(padded, i, F.lit(2))
        )
        numbered = F.transform(
            F.sort_array(F.col("_grams")),
            lambda g, i: F.concat(
                g,
                F.size(F.filter(F.slice(F.sort_array(F.col("_grams")), F.lit(1), i + 1), lambda o: o == g)).cast(
                    "string"
                ),
            ),
        )
        return texts.withColumn("_grams", grams).select(
            key, "_text", F.length("_text").alias("_len"), F.explode(numbered).alias("gram")
        )

    a, b = explode(left, "name_key"), explode(right, "choice_key")
    frequency = _counts(b, "gram")
    share = F.lit((1.5 * c - 1) * 2 / (2 - c))
    keep = F.col("_len") + 1 - F.ceil(share * F.col("_len") - F.lit(_SLACK))
    one = _rarest(a, frequency, ["name_key", "_text"], keep).select("name_key", "gram").distinct()
    two = _rarest(b, frequency, ["choice_key", "_text"], keep).select("choice_key", "gram").distinct()
    return one.join(two, "gram").select("name_key", "choice_key")


def _window_candidates(left: DataFrame, right: DataFrame, c: float) -> DataFrame:
    """Pairs in which the shorter text may match a window of the longer at c (0…1).

    By the same count at least 2 l (1.5 c - 1) / (2 - c) - 1 of the shorter
    text's bigrams are in the longer text; one-letter texts go by their letter.
    """
    share = F.lit((1.5 * c - 1) * 2 / (2 - c))

    def texts(df: DataFrame, key: str) -> DataFrame:
        return df.select(
            key, F.length(key).alias("_full"), F.explode(_word_texts(F.col(key))).alias("_text")
        )

    def bigrams(text: Column) -> Column:
        n = F.length(text)
        return F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))
        )

    def everything(df: DataFrame, key: str) -> DataFrame:
        letters = F.split(F.col("_text"), "")
        return (
            texts(df, key)
            .select(key, "_full", F.explode(F.concat(bigrams(F.col("_text")), letters)).alias("gram"))
            .filter(F.col("gram") != "")
            .distinct()
        )

    def rare(df: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
        grams = texts(df, key).select(
            key, "_full", "_text", F.length("_text").alias("_len"), F.posexplode(bigrams(F.col("_text"))).alias("_p", "gram")
        )
        need = F.ceil(share * F.col("_len") - 1 - F.lit(_SLACK))
        keep = F.greatest(F.col("_len") - need, F.lit(1))
        return _rarest(grams, frequency, [key, "_text"], keep).select(key, "_full", "gram").distinct()

    out = None
    for short, long, short_key, long_key in (
        (left, right, "name_key", "choice_key"),
        (right, left, "choice_key", "name_key"),
    ):
        index = everything(long, long_key).withColumnRenamed("_full", "_full_long")
        frequency = _counts(index, "gram")
        # Either side: dropping repeated words can make the longer name's text the shorter.
        apart = F.greatest("_full_long", "_full") / F.least("_full_long", "_full")
        pairs = (
            rare(short, short_key, frequency)
            .join(index, "gram")
            .filter((apart >= PARTIAL_FROM) & (apart <= FAR_FROM))
            .select("name_key", "choice_key")
        )
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _words(df: DataFrame, key: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.col(key), " "), lambda w: w != ""))
    return df.select(key, F.length(key).alias("_full"), words.alias("_words"))


def _subset_candidates(left: DataFrame, right: DataFrame, c: float) -> DataFrame:
    """Pairs where shared words make up so much of one side that the set ratio may reach c.

    Words not shared then weigh at most β / (1 + β) of that side, with
    β = 2 (1 - c) / c; so one of its rarest words beyond that weight is shared.
    """
    beta = 2 * (1 - c) / c
    limit = beta / (1 + beta)

    out = None
    for one, other, one_key, other_key in (
        (left, right, "name_key", "choice_key"),
        (right, left, "choice_key", "name_key"),
    ):
        index = _words(other, other_key).select(
            other_key, F.col("_full").alias("_other"), F.explode("_words").alias("word")
        )
        frequency = _counts(index, "word")
        words = _words(one, one_key)
        total = F.aggregate("_words", F.lit(0), lambda acc, w: acc + F.length(w) + 1)
        weighed = words.select(one_key, "_full", total.alias("_total"), F.explode("_words").alias("word"))
        line = (
            Window.partitionBy(one_key)
            .orderBy(F.coalesce(F.col("n"), F.lit(0)), "word")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = F.coalesce(F.sum(F.length("word") + 1).over(line), F.lit(0))
        rare = (
            weighed.join(frequency, "word", "left")
            .withColumn("_before", before)
            .filter(F.col("_before") <= F.lit(limit) * F.col("_total") + F.lit(_SLACK))
        )
        spread = F.greatest("_full", "_other") / F.least("_full", "_other")
        pairs = rare.join(index, "word").filter(spread < PARTIAL_FROM).select("name_key", "choice_key")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _shared_word_best(names: DataFrame, choices: DataFrame) -> DataFrame:
    """First choice that shares a word at a length where that alone sets the score.

    All such pairs score the same, so a choice is kept per word and length and
    no pairs are formed, however common the word.
    """
    first = F.min(F.struct("entity_id", "choice_key")).alias("_first")
    index = (
        choices.select("entity_id", "choice_key", F.length("choice_key").alias("_other"), F.explode(
            F.array_distinct(F.filter(F.split("choice_key", " "), lambda w: w != ""))).alias("word"))
        .groupBy("word", "_other")
        .agg(first)
    )
    words = _words(names, "name_key").select("name_key", "_full", F.explode("_words").alias("word"))
    spread = F.greatest("_full", "_other") / F.least("_full", "_other")
    met = words.join(index, "word").filter((spread >= PARTIAL_FROM) & (spread <= FAR_FROM))
    return (
        met.groupBy("name_key")
        .agg(F.min("_first").alias("_first"))
        .select("name_key", "_first.choice_key", "_first.entity_id", F.lit(SHARED_WORD_SCORE).alias("score"))
    )


def weighted_candidates(names: DataFrame, choices: DataFrame, cutoff: float) -> DataFrame:
    """Pairs that may reach the cut-off of the weighted ratio other than by one shared word."""
    c = cutoff / 100
    return (
        _alike_candidates(names, choices, c)
        .unionByName(_window_candidates(names, choices, c / PARTIAL_SCALE))
        .unionByName(_subset_candidates(names, choices, c / TOKEN_SCALE))
        .distinct()
    )


def best_matches(
    names: DataFrame, choices: DataFrame, cutoff: float = 80.0, scorer: str = "weighted"
) -> DataFrame:
    """(name_key, choice_key, entity_id, score): best choice at or above the cut-off.

    Ties go to the lowest entity, then to the first key. ``weighted`` is the
    weighted ratio, scored by an Arrow UDF on the candidate pairs; ``edit`` is the
    better edit similarity of the names and of their sorted words, in the JVM.
    Both find what comparing every name with every choice would.
    """
    keys = cut_lineage(names.select("name_key").filter(F.trim("name_key") != "").distinct(), "names")
    options = cut_lineage(choices.select("choice_key", "entity_id").filter(F.trim("choice_key") != ""), "choices")
    distinct = options.select("choice_key").distinct()
    if scorer == "edit":
        pairs = edit_candidates(keys, distinct, cutoff)
        score = name_similarity(F.col("name_key"), F.col("choice_key"))
    elif scorer == "weighted":
        if cutoff <= 100 * max(FAR_SCALE, 2 / 3):
            raise ValueError("the weighted ratio needs a cut-off above 66.7")
        pairs = weighted_candidates(keys, distinct, cutoff)
        score = weighted_similarity(F.col("name_key"), F.col("choice_key"))
    else:
        raise ValueError(f"unknown scorer {scorer!r}")
    scored = pairs.withColumn("score", score).filter(F.col("score") >= cutoff)
    found = scored.join(options, "choice_key").select("name_key", "choice_key", "entity_id", "score")
    if scorer == "weighted" and cutoff <= SHARED_WORD_SCORE:
        found = found.unionByName(_shared_word_best(keys, options))
    return first_per_key(
        found, ["name_key"], [F.desc("score"), F.col("entity_id"), F.col("choice_key")]
    ).select("name_key", "choice_key", "entity_id", "score")
