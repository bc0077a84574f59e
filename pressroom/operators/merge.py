"""Updates by key, written as joins. Plain files have no MERGE: results go to a new version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import latest


def update_all(target: DataFrame, updates: DataFrame, on: Mapping[str, str],
               assign: Sequence[str]) -> DataFrame:
    """Set the ``assign`` columns on every target row whose key is in ``updates``.

    ``on`` maps target columns to update columns. ``updates`` must hold a key once;
    updates without a target row are ignored. Only the target side can repeat a
    key, which an adaptive skew join can split.
    """
    change = updates.select(*[F.col(u).alias(f"_k{i}") for i, u in enumerate(on.values())],
                            F.struct(*assign).alias("_new"))
    same = [F.col(t) == F.col(f"_k{i}") for i, t in enumerate(on)]
    joined = target.join(change, same, "left")
    value = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
             for c in assign}
    return joined.select(*[value.get(c, F.col(c)) for c in target.columns])


def update_first(target: DataFrame, updates: DataFrame, on: Mapping[str, str], assign: Sequence[str],
                 row_id: str) -> DataFrame:
    """As ``update_all``, but changes one row per key only: the one with the least id."""
    change = updates.select(*[F.col(u).alias(t) for t, u in on.items()], F.struct(*assign).alias("_set"))
    first = (target.select(*on, row_id).join(change.select(*on), list(on), "left_semi")
             .groupBy(*on).agg(F.min(row_id).alias("_id")))
    by_id = first.join(change, list(on)).select("_id", "_set.*")
    return update_all(target, by_id, {row_id: "_id"}, assign)


def one_per_key(updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Reduce repeated updates of a key to the last one."""
    return latest(updates, keys, order)


def late_enrichment(user_articles: DataFrame, enriched: DataFrame) -> DataFrame:
    """Give reader rows that arrived after their article was enriched its summary and tags.

    ``enriched``: one row per (feedurl, link) with summary, tags and updatedat. Rows that have a
    summary pass by without meeting the join, so only those that lack one are shuffled.
    """
    change = enriched.select(F.col("feedurl").alias("_feed"), F.col("link").alias("_link"),
                             F.struct("summary", "tags", "updatedat").alias("_new"))
    lacking = F.coalesce("summary", F.lit("")) == ""
    joined = user_articles.where(lacking).join(
        change, (F.col("feedurl") == F.col("_feed")) & (F.col("href") == F.col("_link")), "left")
    new = {c: F.coalesce(f"_new.{c}", c).alias(c) for c in ("summary", "tags", "updatedat")}
    return user_articles.where(~lacking).unionByName(joined.select(*[new.get(c, F.col(c)) for c in user_articles.columns]))
