"""Trigram similarity of two strings: shared trigrams of their padded words over all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substr(w, k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """0 where both have no trigrams."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(F.array_union(x, y))), F.lit(0.0))
