"""Vector expressions on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .text import py_strip, py_words

#: Decimal places that decide comparisons of cosines, so that the order of summation cannot.
COSINE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; null for a zero vector."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def hashed_vector(col: Column, dim: int = 64) -> Column:
    """Word counts of a text folded into ``dim`` buckets by MD5.

    A stand-in for a language model that needs no download. It depends on the text alone, so
    it can be cached by text. Texts of fewer than 3 characters give the zero vector.
    """
    words = F.when(F.length(py_strip(col)) < 3, F.array().cast("array<string>")).otherwise(py_words(F.lower(col)))
    buckets = F.transform(
        words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    )
    def counted(found: Column) -> Column:
        # each bucket that occurs is counted once, then looked up for its place
        return F.map_from_entries(F.transform(F.array_distinct(found), lambda b: F.struct(b, F.size(F.filter(found, lambda x: x == b)).cast("double"))))

    places = F.sequence(F.lit(0), F.lit(dim - 1))
    return let(let(buckets, counted), lambda counts: F.transform(places, lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0.0))))
