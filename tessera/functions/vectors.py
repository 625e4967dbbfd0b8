"""Column functions on dense and sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import words


def hashed_bag(text: Column, dims: int = 64) -> Column:
    """A stand-in for a dense model: word counts in ``dims`` hashed places, of unit length (zeros for no words)."""
    place = F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dims).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(place, lambda p: p == k)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector has only finite numbers, not all zero, and perhaps a given size."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)
    return good & (F.size(vector) == size) if size else good
