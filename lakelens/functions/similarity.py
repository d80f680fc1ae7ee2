"""Trigram sets and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text) -> Column:
    """Distinct three-character runs of the lower-case words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    runs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(runs)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, na=None, nb=None) -> Column:
    """Zero if either vector is zero."""
    d = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)
