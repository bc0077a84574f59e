"""Numeric expressions: vectors, probabilities, repeatable draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)


def digest(key: Column, seed: int) -> Column:
    """Order that looks random but is the same on every run and after every retry."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def uniform(key: Column, seed: int) -> Column:
    """Repeatable draw in [0, 1)."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of norm 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def preference(isliked: Column, issaved: Column) -> Column:
    """Label of an interaction: 1, 0 or -1. Anything but ``issaved = false`` counts as liked."""
    return F.when(~issaved.eqNullSafe(F.lit(False)), 1).when(isliked.isNull(), 0) \
        .when(isliked, 1).otherwise(-1)


def score_struct(dislike: Column, neutral: Column, like: Column) -> Column:
    """Score document; ``preferenceScore`` is null where a side is missing."""
    return F.struct(neutral.alias("neutral"), like.alias("like"), dislike.alias("dislike"),
                    (like - dislike).alias("preferenceScore"))
