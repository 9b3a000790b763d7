"""Column functions on embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine as double; 0.0 when either vector is all zeros."""
    norms = F.sqrt(_sum(_product(a, a))) * F.sqrt(_sum(_product(b, b)))
    return F.when(norms == 0, 0.0).otherwise(_sum(_product(a, b)) / F.when(norms != 0, norms))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Masked mean of token vectors; a mask without any token is an error."""
    used = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    kept = F.filter(
        F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0
    )
    zeros = F.transform(tokens[0], lambda _: F.lit(0.0))
    total = F.aggregate(
        kept,
        zeros,
        lambda acc, z: F.zip_with(acc, z["t"], lambda s, x: s + x.cast("double") * z["m"]),
    )
    mean = F.transform(total, lambda s: s / F.greatest(used, F.lit(1e-9)))
    return F.when(used == 0, F.raise_error("attention mask is all zeros").cast("array<double>")).otherwise(mean)
