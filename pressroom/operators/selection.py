"""Exact per-group selection that never sorts a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_smallest(df: DataFrame, keys: Sequence[str], quotas: DataFrame | Column, order: Sequence[Column],
                  buckets: Sequence[Column]) -> DataFrame:
    """Add ``picked``: true for exactly ``quota`` rows of each group, the smallest by ``order``.

    ``quotas`` is a column over the keys, or has one row per group: the keys, ``quota``
    and further columns to attach. ``buckets`` are coarser versions of ``order`` (a hash prefix, say):
    rows of a lower bucket come before all rows of a higher one.

    A histogram over (group, bucket) says how many rows each bucket may give, so
    rows only meet the rows of their own bucket. A group holding a third of the
    table is spread over its buckets; the running sum sees one row per bucket.
    """
    keys = list(keys)
    names = [f"_bucket{i}" for i in range(len(buckets))]
    rows = df.withColumns(dict(zip(names, buckets)))
    histogram = rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    histogram = histogram.join(quotas, keys) if isinstance(quotas, DataFrame) \
        else histogram.withColumn("quota", quotas)
    so_far = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*names)
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    take = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("quota") - so_far + F.col("_n")))
    budget = histogram.withColumn("_take", take).drop("_n", "quota")
    rank = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return (rows.join(budget, [*keys, *names])
            .withColumn("picked", rank <= F.col("_take")).drop("_take", *names))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``.

    An aggregate rather than a ranking window, so copies are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
