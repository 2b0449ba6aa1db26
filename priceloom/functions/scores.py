"""Scores of two names by how they begin and by the words they share, as column expressions.

A name without the words that a score takes scores 0; null names have none.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions import models as D

# Weights of the three scores, what a common article and a known id are worth at least.
PREFIX, HEAD, TOKENS = 0.20, 0.30, 0.50
BY_ARTICLE, BY_ID = 0.95, 0.7


def first_words(name: Column, most: int = 6) -> Column:
    """The first words of two characters and more."""
    return F.slice(F.filter(D.words(F.coalesce(name, F.lit(""))), lambda w: F.length(w) >= 2), 1, most)


def _share(common: Column, a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, common / smaller).otherwise(0.0)


def prefix_score(a: Column, b: Column) -> Column:
    """The share of places, of the first four that both have, at which the two names have the same word."""
    x, y = F.slice(first_words(a), 1, 4), F.slice(first_words(b), 1, 4)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return _share(F.size(F.filter(same, lambda s: s)), x, y)


def head_score(a: Column, b: Column) -> Column:
    """The words that the first six of both share, over the fewer of the two."""
    x, y = first_words(a), first_words(b)
    return _share(F.size(F.array_intersect(x, y)), x, y)


def plain_tokens(name: Column, shortest: int = 4) -> Column:
    """Latin words with dots, dashes and slashes, of which at least `shortest` letters and digits are left without them."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9._/-]{2,})")), D.compact)
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= shortest))


def token_score(a: Column, b: Column) -> Column:
    x, y = plain_tokens(a), plain_tokens(b)
    return _share(F.size(F.array_intersect(x, y)), x, y)


def id_score(name: Column, catalog_name: Column) -> Column:
    """How well a name fits the catalog's name of its id: the three scores weighed, no less for a common article or for the id itself; 1 where the catalog has no name."""
    blend = PREFIX * prefix_score(name, catalog_name) + HEAD * head_score(name, catalog_name) + TOKENS * token_score(name, catalog_name)
    article = F.when(F.arrays_overlap(D.articles(F.coalesce(name, F.lit(""))), D.articles(F.coalesce(catalog_name, F.lit("")))), BY_ARTICLE).otherwise(0.0)
    return F.when(F.coalesce(F.trim(catalog_name), F.lit("")) == "", 1.0).otherwise(F.round(F.greatest(blend, article, F.lit(BY_ID)), 3))
