"""Cheap checks of a statement against the text it is said to rest on: numbers, denials, names and relations that the text does not bear out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract_numbers

# Words of denial.
NEGATIONS = ("not", "no", "never", "cannot", "n't", "without", "neither", "nor", "none")
# Pairs of opposite relation words.
OPPOSITES = (
    ("beats", "loses"), ("faster", "slower"), ("more", "less"), ("above", "below"), ("higher", "lower"), ("larger", "smaller"),
    ("increases", "decreases"), ("wins", "fails"), ("stronger", "weaker"), ("exceeds", "trails"), ("lifts", "floors"), ("catches", "misses"),
)


def bare_words(text: Column) -> Column:
    """The blank-separated words of a text in lower case, without the marks . , ; : at their ends."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", ""))


def numbers(text: Column) -> Column:
    """The numbers of a text as doubles."""
    return F.transform(extract_numbers(text), lambda n: n.cast("double"))


def number_covered(number: Column, pool: Column) -> Column:
    """Whether a number is among those of an array, up to 1e-9."""
    return F.exists(pool, lambda x: F.abs(x - number) <= 1e-9)


def uncovered_number(claim: Column, source: Column) -> Column:
    """Whether the claim names a number that the source does not."""
    return F.exists(numbers(claim), lambda n: ~number_covered(n, numbers(source)))


def negation_suspect(claim: Column, source: Column) -> Column:
    """Whether the first word of denial in the claim does not occur in the source."""
    first = F.get(F.filter(bare_words(claim), lambda w: w.isin(*NEGATIONS)), 0)
    return F.coalesce(~F.contains(F.lower(F.coalesce(source, F.lit(""))), first), F.lit(False))


def unknown_entity(claim: Column, source: Column) -> Column:
    """Whether a capitalised word of five or more letters of the claim does not occur in the source, letter case aside."""
    names = F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(r"\b([A-Z][a-zA-Z_]{4,})\b"), 1)
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.exists(names, lambda e: ~F.contains(low, F.lower(e)))


def reversed_relation(claim: Column, source: Column) -> Column:
    """Whether the claim asserts a relation word whose opposite is in the source, while the word itself is not."""
    mine, low = bare_words(claim), F.lower(F.coalesce(source, F.lit("")))
    hits = [F.array_contains(mine, a) & F.contains(low, F.lit(b)) & ~F.contains(low, F.lit(a)) for x, y in OPPOSITES for a, b in ((x, y), (y, x))]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out
