"""Text cleaning: tolerant parsing, key normalisation, category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered substring rules, first hit wins.
ROUND_RULES: tuple[tuple[tuple[str, ...], int], ...] = (
    (("first four",), 0),
    (("first round", "second round"), 1),
    (("third round",), 2),
    (("sweet 16", "sweet sixteen"), 3),
    (("elite 8", "elite eight"), 4),
    (("final four",), 5),
    (("championship",), 6),
)
# Markup that is removed before the rules are tried.
ROUND_NOISE: tuple[str, ...] = ("&#174;", "®")

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip_space(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def lenient_int(c: Column) -> Column:
    """Integer value of a string, NULL when it is not one (``'7.9'`` is not)."""
    return c.try_cast("int")


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def split_record(c: Column, sep: str = "-") -> tuple[Column, Column]:
    """``'185-23'`` → (185, 23).

    Without a separator, or with a bad first part, both are NULL; a bad second
    part leaves the first in place.
    """
    parts = F.split(c, sep)
    first = F.when(F.contains(c, F.lit(sep)), F.get(parts, F.lit(0)).try_cast("int"))
    second = F.when(first.isNotNull(), F.get(parts, F.lit(1)).try_cast("int"))
    return first, second


def first_non_empty(*candidates: Column) -> Column:
    """First argument that is neither NULL nor the empty string, else ``''``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def pad_array(c: Column, width: int) -> Column:
    """Array of exactly ``width`` items: cut on the right or filled with NULL."""
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(c, i)
    )
    return padded


def normalize_key(c: Column) -> Column:
    """Join key of a name: trimmed, lower case, no periods, single spaces."""
    bare = F.replace(F.lower(strip_space(c)), F.lit("."), F.lit(""))
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def slugify(c: Column) -> Column:
    """Lower case, hyphens for spaces, no apostrophes."""
    return F.translate(F.lower(c), " '", "-")


def normalize_category(
    c: Column,
    rules: Sequence[tuple[Sequence[str], int]] = ROUND_RULES,
    noise: Sequence[str] = ROUND_NOISE,
    unknown: int = -1,
) -> Column:
    """Messy category text → ordinal: rules in order, then a number, then ``unknown``."""
    text = F.lower(c)
    for token in noise:
        text = F.replace(text, F.lit(token), F.lit(""))
    text = strip_space(text)
    code: Column | None = None
    for words, value in rules:
        hit = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(text, F.lit(word))
        code = F.when(hit, F.lit(value)) if code is None else code.when(hit, F.lit(value))
    fallback = F.coalesce(text.try_cast("int"), F.lit(unknown))
    return fallback if code is None else code.otherwise(fallback)


def period_label(year: Column) -> Column:
    """2025 → ``'2024-2025'``."""
    return F.concat_ws("-", (year - 1).cast("string"), year.cast("string"))


def encode_variants(c: Column) -> Column:
    return F.to_json(c)


def decode_variants(c: Column) -> Column:
    """JSON array text → array of strings; NULL for malformed text."""
    return F.from_json(c, "array<string>")
