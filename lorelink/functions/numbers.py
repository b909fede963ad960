"""Probabilities and features on counts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

#: Fixed value: what is added to a count before it divides.
EPSILON = 0.00001


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(col(whole) == 0, F.lit(0.0)).otherwise(F.try_divide(col(part).cast("double"), col(whole).cast("double")))


def link_probability(link_doc: Column | str, text_doc: Column | str, text_occ: Column | str) -> Column:
    return F.when(col(text_occ) == 0, F.lit(0.0)).otherwise(F.try_divide(col(link_doc).cast("double"), col(text_doc).cast("double")))


def sense_probability(sense_doc: Column | str, text_doc: Column | str, text_occ: Column | str) -> Column:
    return link_probability(sense_doc, text_doc, text_occ)


def prior_probability(sense_occ: Column | str, link_occ: Column | str) -> Column:
    return share(sense_occ, link_occ)


def inverse_frequency(articles: Column, count: Column | str) -> Column:
    """ln(N / (count + epsilon)), 0 without a count."""
    return F.coalesce(F.ln(articles / (col(count) + EPSILON)), F.lit(0.0))


def per_count(part: Column | str, whole: Column | str) -> Column:
    return col(part) / (col(whole) + EPSILON)


def relatedness_of_counts(common: Column | str, a: Column | str, b: Column | str, articles: Column) -> Column:
    """Of two articles with a and b distinct links, of which `common` are shared, 0 to 1: a normalised distance of link sets against all articles.

    0 if either has no links or they share none, 1 if they are equal.
    """
    n, la, lb = col(common), F.ln(col(a)), F.ln(col(b))
    raw = 1 - (F.greatest(la, lb) - F.ln(n)) / (F.ln(articles) - F.least(la, lb))
    full = (n == col(a)) & (n == col(b))
    return F.when(n == 0, F.lit(0.0)).when(full, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.0)))))


def relatedness(a: Column | str, b: Column | str, articles: Column) -> Column:
    """As relatedness_of_counts(), of two arrays of distinct links: for a few articles at hand; operators count instead."""
    return let(F.size(F.array_intersect(col(a), col(b))), lambda common: relatedness_of_counts(common, F.size(col(a)), F.size(col(b)), articles))
