"""Trigram similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two sets given as arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(x: Column, y: Column) -> Column:
    return set_similarity(trigrams(x), trigrams(y))
