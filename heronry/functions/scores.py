"""Scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two maps of weights: over the keys of both."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) * F.try_element_at(b, k))


def bm25_weight(tf: Column, length: Column, k1: float = 1.2, b: float = 0.75, average: float = 256.0) -> Column:
    """Saturated term frequency; no inverse document frequency."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def reciprocal_rank_fusion(dense: Column, lexical: Column, n_dense: Column, n_pool: Column, w_dense: float = 0.6, w_lexical: float = 0.4, k: int = 60) -> Column:
    """A rank that is missing counts as 10 behind the last: of the dense hits, or of the pool."""
    return F.lit(w_dense) / (k + F.coalesce(dense, n_dense + 10)) + F.lit(w_lexical) / (k + F.coalesce(lexical, n_pool + 10))


def title_matches(title: Column, acceptable: Column) -> Column:
    """Equal, or one inside the other, in lower case and stripped; an empty title matches everything."""
    from .text import strip

    t = F.lower(strip(title))
    return F.exists(acceptable, lambda a: F.contains(t, F.lower(strip(a))) | F.contains(F.lower(strip(a)), t))


def band(score: Column) -> Column:
    return F.when(score >= 0.70, "green").when(score >= 0.50, "yellow").otherwise("red")


def index_percentile(values: Column, q: float) -> Column:
    """sorted(values)[min(floor(n * q), n - 1)]; not an interpolated percentile."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(q)), F.size(ordered) - 1).cast("int"))


def quantized(vector: Column, scale: Column) -> Column:
    """Components over scale times 127, clipped, as TINYINT."""
    return F.transform(vector, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") / scale)) * 127).cast("tinyint"))
