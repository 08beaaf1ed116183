"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each measure of a document falls into a bucket of a logarithmic scale. The counts per
bucket are a quantile sketch that merges by addition, in any order, with a relative
error of half a bucket. Sketches per language and source (of the language, or of all
documents, where a group is small) give fences around the median, and documents beyond
a fence of their group are rejected by a join with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import store

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
#: Ratio of the upper and lower end of a bucket.
GAMMA = 1.02


@dataclass(frozen=True)
class Rule:
    """A measure, its least value that has a bucket of its own, the least spread in buckets
    that a group is taken to have, and the sides on which values are rejected."""

    name: str
    least: float
    spread: int
    high: bool = True
    low: bool = False


#: Characters of a word, symbols per word, and the shares of lines and words that are repeats.
#: In a group whose values are all alike the fences lie a factor of 1.6, 7.2, 2.6 and 2.6 from the median.
RULES = (
    Rule("word_length", 0.01, 6, low=True),
    Rule("symbols", 0.01, 25),
    Rule("repeated_lines", 0.1, 12),
    Rule("repeated_words", 0.1, 12),
)


def _shifted(x: Column, by: int, length: Column) -> Column:
    return F.slice(x, F.lit(by + 1), length)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(key, *keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), all counts long.

    One narrow pass over whole texts; a null text has no words. Repeated windows are
    found by sorting the hashes of a text's windows, so the time of a text grows with
    its length times the logarithm of it.
    """
    carried = [F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep]]
    held = ["key", *[f"keep_{c}" for c in keep]]
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     "))) > 0)
    words = F.filter(F.split(value, SPACE), lambda w: w != "")
    first = docs.select(
        *carried, words.alias("words"), lines.alias("lines"), F.regexp_count(value, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols")
    )
    n = F.size("words")
    hashed = first.select(
        *held,
        "n_symbols",
        n.cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    length = F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))
    pairs = F.zip_with(_shifted(F.col("h"), 0, length), _shifted(F.col("h"), 1, length), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, _shifted(F.col("h"), 2, length), lambda a, b: F.xxhash64(a, b))
    windowed = hashed.withColumn("w", windows).drop("h")
    numbered = F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct("w")) < F.size("w")
    ordered = windowed.withColumn("s", F.when(some, F.array_sort(numbered))).drop("w")
    m = F.size("s")
    after = F.concat(F.slice("s", F.lit(2), m), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("s", F.lit(1), m - 1))
    alike = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    places = F.zip_with(
        F.zip_with("s", before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), alike(a, b).alias("hit"))),
        after,
        lambda a, b: F.when(a["hit"] | alike(a, b), a["i"]),
    )
    found = ordered.withColumn("p", F.sort_array(F.filter(places, lambda i: i.isNotNull()))).drop("s")
    gaps = F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.least(b - a, F.lit(3)))  # null for the last, read as 3
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + F.coalesce(gap, F.lit(3)))
    return found.select(
        F.col("key").alias(key),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def bucket(value: Column, least: float) -> Column:
    """Number of the bucket of a value; all values up to ``least`` share one."""
    return F.ceil(F.log(F.greatest(value, F.lit(least))) / F.log(F.lit(GAMMA))).cast("int")


def with_buckets(measured: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    ratios = {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
    }
    return measured.withColumns({f"b_{r.name}": bucket(ratios[r.name], r.least) for r in RULES})


def sketches(bucketed: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, rule, bucket, n): mergeable sketches of all documents that have a word."""
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"b_{r.name}").alias("bucket")) for r in RULES]))
    long = bucketed.filter(F.col("n_words") > 0).select(*groups, rows.alias("x"))
    return long.groupBy(*groups, F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """The sketches of coarser groups: sums of the finer ones."""
    return sketch.groupBy(*groups, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, rule, docs, q1, q2, q3): the first bucket that reaches each quarter."""
    of = Window.partitionBy(*groups, "rule")
    summed = sketch.withColumn("upto", F.sum("n").over(of.orderBy("bucket"))).withColumn("docs", F.sum("n").over(of))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket")))
    return summed.groupBy(*groups, "rule").agg(F.max("docs").alias("docs"), *[at(k).alias(f"q{k}") for k in (1, 2, 3)])


def fences(sketch: DataFrame, groups: tuple[str, ...] = ("lang", "source"), least_docs: int = 200, width: int = 4) -> DataFrame:
    """(groups, lo_rule, hi_rule …): buckets beyond which a document of the group is rejected.

    A fence lies ``width`` spreads from the median; the spread is the distance to the
    quartile on the other side, which outliers on this side do not move, and at least
    the least spread of the rule. A group with fewer than ``least_docs`` documents takes the
    sketch of its first column, or of all documents if that is small too.
    """
    own = quartiles(sketch, groups)
    upper = quartiles(merge(sketch, groups[:1]), groups[:1]).withColumnsRenamed({c: f"upper_{c}" for c in ("docs", "q1", "q2", "q3")})
    whole = quartiles(merge(sketch, ()), ()).withColumnsRenamed({c: f"all_{c}" for c in ("docs", "q1", "q2", "q3")})
    levels = own.join(upper, [groups[0], "rule"]).join(whole, "rule")

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("docs") >= least_docs, F.col(name))
            .when(F.col("upper_docs") >= least_docs, F.col(f"upper_{name}"))
            .otherwise(F.col(f"all_{name}"))
        )

    picked = levels.select(*groups, "rule", *[chosen(q).alias(q) for q in ("q1", "q2", "q3")])

    def hi(r: Rule) -> Column:
        return F.col("q2") + width * F.greatest(F.col("q2") - F.col("q1"), F.lit(r.spread))

    def lo(r: Rule) -> Column:
        return F.col("q2") - width * F.greatest(F.col("q3") - F.col("q2"), F.lit(r.spread))

    wide = [F.max(F.when(F.col("rule") == r.name, hi(r))).cast("int").alias(f"hi_{r.name}") for r in RULES if r.high]
    wide += [F.max(F.when(F.col("rule") == r.name, lo(r))).cast("int").alias(f"lo_{r.name}") for r in RULES if r.low]
    return picked.groupBy(*groups).agg(*wide)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **limits: int) -> DataFrame:
    """(key, lang, source, counts, base_failed, kept): one row per document.

    Null languages and sources count as empty names. A document without a word fails
    the base rules. Repeated rows count as often as they occur. The counts are stored
    once, so texts are read once; runs a job when called.
    """
    slim = docs.select(
        F.col(f"`{key}`").alias(key),
        F.col(f"`{text}`").alias("__text"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
    )
    measured = store(measure(slim, key, "__text", ("lang", "source")), "measures")
    bucketed = with_buckets(measured)
    sketch = store(sketches(bucketed, ("lang", "source")), "sketches")
    limits_of = store(fences(sketch, ("lang", "source"), **limits), "fences")
    joined = bucketed.join(limits_of, ["lang", "source"], "left")
    beyond = F.lit(False)
    for r in RULES:
        if r.high:
            beyond = beyond | (F.col(f"b_{r.name}") > F.col(f"hi_{r.name}"))
        if r.low:
            beyond = beyond | (F.col(f"b_{r.name}") < F.col(f"lo_{r.name}"))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return joined.select(
        key, "lang", "source", *counts, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(beyond, F.lit(False))).alias("kept")
    )
