"""Sinks: event log, article archive, rejects, snapshots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import docs as D
from ..operators.selection import latest
from ..session import cut_lineage
from .tables import exists

USER_BUCKETS = 64


def _replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(rows: DataFrame, path: str, batch: str) -> None:
    """Append rows of the event log.

    Folders go by collection, operation and day, as a folder per reader would mean
    millions of tiny files; a reader's bucket narrows the scan instead, and the key
    of each event keeps the full address. A replayed batch replaces its own files.
    """
    bucketed = rows.withColumns({"user_bucket": F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)),
                                 "batch": F.lit(batch)})
    by = ["collection", "operation_type", "year", "month", "day", "batch"]
    _replace_partitions(bucketed.sortWithinPartitions(*by, "user_bucket"), path, by)


def archive_articles(articles: DataFrame, path: str) -> None:
    """Store articles under their day of creation and key; what comes in replaces what is stored
    under its key, whatever their dates; of several that come in together the later update counts.

    Only the days met are rewritten, together with what they already hold, and from a
    staged copy, so a failed write loses nothing.
    """
    spark = articles.sparkSession
    by = ["year", "month", "day"]
    new = articles.withColumns({
        **D.day_parts(F.col("createdat")), "archive_key": D.archive_key(F.col("createdat"), F.col("link"))})
    both = new.withColumn("_incoming", F.lit(True))
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        old = old.join(F.broadcast(new.select(*by).distinct()), by, "left_semi")  # bounded by the calendar
        both = both.unionByName(old.withColumn("_incoming", F.lit(False)))
    content = F.md5(F.to_json(F.struct(*articles.columns)))
    best = latest(both.withColumn("_content", content), [*by, "archive_key"], ["_incoming", "updatedat", "feedurl", "_content"])
    _replace_partitions(cut_lineage(best.drop("_incoming", "_content")), path, by)


def reject(rows: DataFrame, path: str, batch: str) -> None:
    """Set messages aside: job, message_id, body, error, receives."""
    _replace_partitions(rows.withColumn("batch", F.lit(batch)), path, ["job", "batch"])


def snapshot(tables: dict[str, DataFrame], root: str, at: datetime | None = None) -> str:
    """Dump whole tables as compressed JSON into one timestamped folder.

    Rows are counted as they are written, in the one pass over the table, and again in the files.
    """
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H-%M-%S.%fZ")
    folder = f"{root}/snapshot_ts={stamp}"
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "gzip").json(f"{folder}/{name}")
        stored = df.sparkSession.read.text(f"{folder}/{name}").count()
        if stored != seen.get["rows"]:
            raise RuntimeError(f"snapshot of {name} is incomplete: {stored} rows of {seen.get['rows']}")
    return folder


def read_snapshot(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{name}")
