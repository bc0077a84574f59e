"""Training sets for all readers at once: rows, labels, balancing, hold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import digest, preference, uniform
from ..session import cut_lineage
from .selection import mark_smallest

SEED = 42
USER = "userid"
BUCKET_DIGITS = 3  # 4,096 buckets per reader


def training_rows(user_articles: DataFrame, backend_articles: DataFrame) -> DataFrame:
    """Distinct interactions joined to the summary of the article, bulk reads left out.

    Only the summary is taken from the article side, so that side is reduced to
    distinct (link, summary) first: copies of one article in many feeds would
    otherwise meet every interaction with it, only to be dropped by DISTINCT.
    """
    kept = user_articles.where("isliked is not null or action != 'markAllAsRead' or action is null") \
        .select("href", "title", USER, "issaved", "isliked", "action")
    summaries = backend_articles.select("link", "summary").distinct()
    return (kept.join(summaries, kept["href"] == summaries["link"])
            .select("title", USER, "issaved", "isliked", "action", "summary").distinct())


def row_key() -> Column:
    """Identity of a training row: fixed-width digests first, so no two rows run together."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    def text(name: str) -> Column:
        return F.md5(F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null")))

    return F.md5(F.concat_ws(":", flag("issaved"), flag("isliked"), text("action"), text("title"),
                             text("summary"), F.col(USER)))


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Add ``row_key`` and turn missing summaries into empty ones."""
    return rows.withColumn("row_key", row_key()).withColumn("summary", F.coalesce("summary", F.lit("")))


def with_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", preference(F.col("isliked"), F.col("issaved")))


def training_stats(rows: DataFrame) -> DataFrame:
    """Per reader: counts before balancing and of each label."""
    return with_label(rows).groupBy(USER).agg(
        F.count_if(F.col("isliked").isNotNull()).alias("labeled_count"),
        F.count_if(F.col("isliked").isNull()).alias("neutral_count"),
        *[F.count_if(F.col("y") == k).alias(n) for k, n in ((1, "n_like"), (0, "n_neutral"), (-1, "n_dislike"))])


def label_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("isliked").isNotNull()), rows.where(F.col("isliked").isNull())


def _by_digest(seed: int) -> dict[str, list[Column]]:
    d = digest(F.col("row_key"), seed)
    return {"order": [d, F.col("row_key")], "buckets": [F.substring(d, 1, BUCKET_DIGITS)]}


def smallest(rows: DataFrame, keys: list[str], most: int, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows of every group, those of least digest."""
    return mark_smallest(rows, keys, F.lit(most), **_by_digest(seed)).where("picked").drop("picked")


def balance_neutral(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """All labelled rows and as many neutral ones; every neutral row if nothing is labelled."""
    labelled, neutral = label_split(rows)
    n_labelled = F.count_if(F.col("isliked").isNotNull())
    quotas = rows.groupBy(USER).agg(
        F.when(n_labelled > 0, n_labelled).otherwise(F.count(F.lit(1))).alias("quota"))
    sample = mark_smallest(neutral, [USER], quotas, **_by_digest(seed)).where("picked").drop("picked")
    return labelled.unionByName(sample)


def holdout_split(rows: DataFrame, fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """Mark ``held_out``: a share of each reader's rows, rounded half to even."""
    quotas = rows.groupBy(USER).agg(F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("quota"))
    return mark_smallest(rows, [USER], quotas, **_by_digest(seed)).withColumnRenamed("picked", "held_out")


def force_missing_class(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Give a reader with only one of liked/disliked a first example of the other.

    The first row is the labelled one of least digest, neutral ones coming last.
    Nothing is forced where both are missing.
    """
    first = F.min(F.struct(F.col("isliked").isNull(), digest(F.col("row_key"), seed), "row_key"))
    n_like, n_dislike = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == -1)
    forced = F.when((n_dislike == 0) & (n_like > 0), -1).when((n_like == 0) & (n_dislike > 0), 1)
    change = (rows.groupBy(USER).agg(first["row_key"].alias("row_key"), forced.alias("_forced"))
              .where(F.col("_forced").isNotNull()))
    joined = rows.join(change, [USER, "row_key"], "left")
    return joined.withColumn("y", F.coalesce("_forced", "y")).drop("_forced").select(*rows.columns)


def oversample(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``copies`` so that every class of a reader weighs as much as the largest.

    Rows are repeated in turn, not drawn at random, and only as a weight. ``n`` is the
    reader's total weight, known here without another join.
    """
    sizes = rows.groupBy(USER, "y").agg(F.count(F.lit(1)).alias("_size"))
    user = Window.partitionBy(USER)
    missing = F.col("_most") - F.col("_size")
    quotas = sizes.withColumns({"_most": F.max("_size").over(user), "_k": F.count(F.lit(1)).over(user)}).select(
        USER, "y", (missing % F.col("_size")).alias("quota"), (F.col("_most") * F.col("_k")).alias("n"),
        F.floor(missing / F.col("_size")).cast("int").alias("_rounds"))
    marked = mark_smallest(rows, [USER, "y"], quotas, **_by_digest(seed))
    copies = 1 + F.col("_rounds") + F.col("picked").cast("int")
    return marked.withColumn("copies", copies).select(*rows.columns, "copies", "n")


def neutral_skip(updates: DataFrame, counts: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Mark neutral updates to leave out: with probability 1 - labelled/neutral, where neutral prevail."""
    p = F.when(F.col("neutral_count") > F.col("labeled_count"),
               1 - F.col("labeled_count") / F.col("neutral_count")).otherwise(F.lit(0.0))
    seen = counts.select(USER, "labeled_count", "neutral_count")
    joined = updates.join(seen, USER, "left").withColumn("drop_probability", p)
    skip = (F.col("y") == 0) & (uniform(F.col(key).cast("string"), seed) < F.col("drop_probability"))
    return joined.withColumn("skip", skip).select(*updates.columns, "drop_probability", "skip")


def prepare(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Balanced, labelled and weighted rows (userid, row_key, y, copies, n).

    Works on keys and flags only; the texts are joined back by ``row_key`` afterwards
    instead of travelling through every shuffle. Each step reads its input several
    times (sizes, histogram, rows), hence the two checkpoints of these narrow rows.
    """
    narrow = cut_lineage(rows.select(USER, "row_key", "isliked", "issaved"))
    balanced = with_label(balance_neutral(narrow, seed))
    forced = cut_lineage(force_missing_class(balanced, seed).select(USER, "row_key", "y"))
    return oversample(forced, seed).select(USER, "row_key", "y", "copies", "n")
