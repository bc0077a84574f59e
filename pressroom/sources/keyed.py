"""Tables that change by key at the cost of the change: buckets of rows, and a log of changes merged when read.

Rows lie in buckets by a hash of the ``by`` columns. An update writes one file of changes into each bucket it
touches and nothing else; ``read`` joins the latest changes to the rows of those buckets and takes all other
buckets as they are; ``compact`` rewrites buckets that have gathered many parts. ``log`` names the parts that
count: what a failed job has left behind is never read, and a version that is written again replaces itself.

    root/layout                                 bucket columns, their number, channels, row type
    root/rows/version=7/bucket=3/               rows added (or, by ``compact``, all rows of the bucket)
    root/changes/<channel>/version=8/bucket=3/  keys and new values
    root/log/version=8/                         (kind, bucket): rows, base or the channel, written last

A change applies to the rows its table has when it is written, not to rows added later. Its keys match as in
SQL: a null key matches nothing. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .tables import exists

BUCKETS = 64
MOST_PARTS = 16  # parts of a bucket from which ``compact`` rewrites it


@dataclass(frozen=True)
class Channel:
    """Changes that set the ``assign`` columns of all rows with equal ``on`` columns; a column has one channel."""

    on: tuple[str, ...]
    assign: tuple[str, ...]


class KeyedTable:
    """Opens the table at ``root``; see ``create``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        layout = spark.read.parquet(f"{root}/layout").first()
        self.by, self.buckets = list(layout.by), layout.buckets
        self.channels = {c.name: Channel(tuple(c.on), tuple(c.assign)) for c in layout.channels}
        self.schema = T.StructType.fromJson(json.loads(layout.type))

    @classmethod
    def create(cls, rows: DataFrame, root: str, by: Sequence[str], channels: Mapping[str, Channel],
               buckets: int = BUCKETS) -> KeyedTable:
        """A new table holding ``rows`` as version 0."""
        names = [c for channel in channels.values() for c in channel.assign]
        if len(names) != len(set(names)) or set(names) & set(by):
            raise ValueError("a column can be set by one channel only, and no bucket column at all")
        spark = rows.sparkSession
        layout = [(list(by), buckets, [(n, list(c.on), list(c.assign)) for n, c in channels.items()], rows.schema.json())]
        kind = "by array<string>, buckets int, channels array<struct<name string, on array<string>, assign array<string>>>, type string"
        spark.createDataFrame(layout, kind).coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")
        table = cls(spark, root)
        table.append(rows, 0)
        return table

    # -- parts

    def bucket_of(self, by: Sequence[str] | None = None) -> Column:
        """Bucket of a row from its ``by`` columns, or from columns of another name that hold the same."""
        return F.pmod(F.xxhash64(*(by or self.by)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame, by: Sequence[str] | None = None) -> list[int]:
        """The buckets that rows with these keys lie in; at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket_of(by)).distinct().collect())

    def _log(self) -> list:
        """All (version, kind, bucket): as many as parts have been written."""
        if not exists(self.spark, f"{self.root}/log"):
            return []
        return self.spark.read.schema("kind string, bucket int, version long").parquet(f"{self.root}/log").collect()

    def version(self) -> int:
        return max((r.version for r in self._log()), default=-1)

    def _live(self, since: int = -1) -> dict[str, list[tuple[int, int]]]:
        """(version, bucket) of the parts that count, by kind: since its last rewrite a bucket's rows and changes."""
        log = self._log()
        rewritten: dict[int, int] = {}
        for r in log:
            if r.kind == "base":
                rewritten[r.bucket] = max(r.version, rewritten.get(r.bucket, -1))
        live: dict[str, list[tuple[int, int]]] = {}
        for r in log:
            last = rewritten.get(r.bucket, -1)
            if r.version > max(last, since) or r.kind == "base" and r.version == last:
                live.setdefault("rows" if r.kind == "base" else r.kind, []).append((r.version, r.bucket))
        return live

    def _parts(self, folder: str, parts: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
        """The named parts, with their version and bucket."""
        whole = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], whole)
        paths = [f"{folder}/version={v}/bucket={b}" for v, b in sorted(parts)]
        return self.spark.read.option("basePath", folder).schema(whole).parquet(*paths)

    def _write(self, rows: DataFrame, folder: str, version: int, kind: str) -> list[int]:
        """Rows with their ``bucket`` as one version; notes in the log which buckets it touches."""
        path = f"{folder}/version={version}"
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
        touched = [r[0] for r in self.spark.read.schema(rows.schema).parquet(path).select("bucket").distinct().collect()]
        self.spark.createDataFrame([(kind, b) for b in touched], "kind string, bucket int").coalesce(1) \
            .write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.root}/log/version={version}")
        return touched

    # -- changes

    def append(self, rows: DataFrame, version: int | None = None) -> list[int]:
        """Add rows; gives the buckets touched."""
        version = self.version() + 1 if version is None else version
        return self._write(rows.select(*self.schema.names).withColumn("bucket", self.bucket_of()), f"{self.root}/rows", version, "rows")

    def update(self, channel: str, updates: DataFrame, version: int | None = None, by: Sequence[str] | None = None) -> list[int]:
        """Set a channel's columns on every row whose ``on`` columns are in ``updates``; gives the buckets touched.

        ``updates`` holds a key once, under the names of the channel, and the bucket columns (or ``by`` for
        them). Rows whose bucket columns are all null are looked up by their key first, which reads the key
        columns of the whole table. Updates without a row are no matter.
        """
        c = self.channels[channel]
        version = self.version() + 1 if version is None else version
        names = list(by or self.by)
        known = updates.where(" or ".join(f"{n} is not null" for n in names)).withColumn("bucket", self.bucket_of(names))
        lost = updates.where(" and ".join(f"{n} is null" for n in names))
        if not lost.isEmpty():
            places = self._parts(f"{self.root}/rows", self._live().get("rows", []), self.schema) \
                .select(*[F.col(k).alias(f"_{k}") for k in c.on], "bucket")
            same = [F.col(k) == F.col(f"_{k}") for k in c.on]
            known = known.select(*c.on, *c.assign, "bucket").unionByName(lost.join(places, same).select(*c.on, *c.assign, "bucket").distinct())
        return self._write(known.select(*c.on, *c.assign, "bucket"), f"{self.root}/changes/{channel}", version, channel)

    def update_first(self, channel: str, updates: DataFrame, on: Sequence[str], version: int | None = None) -> list[int]:
        """As ``update``, but a key (``on``, of which the bucket columns are part) changes one row only: that of the
        least row id, the ``on`` column of the channel. Reads the buckets that the keys lie in."""
        c = self.channels[channel]
        row_id, = c.on
        here = self.read(self.buckets_of(updates)).select(*on, row_id)
        first = here.join(updates.select(*on), list(on), "left_semi").groupBy(*on).agg(F.min(row_id).alias(row_id))
        return self.update(channel, cut_lineage(first.join(updates.select(*on, *c.assign), list(on))), version)

    # -- reading

    def added_since(self, version: int) -> DataFrame:
        """Rows added after a version, as they were added."""
        return self._parts(f"{self.root}/rows", self._live(since=version).get("rows", []), self.schema) \
            .where(F.col("version") > version).select(*self.schema.names)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as it is now; only the given buckets are opened."""
        return self._merged(buckets).select(*self.schema.names)

    def _merged(self, buckets: Sequence[int] | None = None) -> DataFrame:
        live = self._live()
        if buckets is not None:
            live = {k: [p for p in parts if p[1] in set(buckets)] for k, parts in live.items()}
        rows = self._parts(f"{self.root}/rows", live.get("rows", []), self.schema)
        for name, c in self.channels.items():
            if name not in live or not live[name]:
                continue
            fields = [self.schema[k] for k in (*c.on, *c.assign)]
            changes = self._parts(f"{self.root}/changes/{name}", live[name], T.StructType(fields))
            last = changes.groupBy("bucket", *c.on).agg(F.max_by(F.struct("version", *c.assign), "version").alias("_new"))
            last = last.select(F.col("bucket").alias("_bucket"), *[F.col(k).alias(f"_{k}") for k in c.on], "_new")
            touched = F.col("bucket").isin(sorted({b for _, b in live[name]}))
            same = [F.col("bucket") == F.col("_bucket"), *[F.col(k) == F.col(f"_{k}") for k in c.on]]
            joined = rows.where(touched).join(last, same, "left")
            newer = F.col("_new.version") > F.col("version")  # rows added later keep what they came with
            value = {k: F.when(newer, F.col(f"_new.{k}")).otherwise(F.col(k)).alias(k) for k in c.assign}
            rows = rows.where(~touched).unionByName(joined.select(*[value.get(k, F.col(k)) for k in rows.columns]))
        return rows

    def compact(self, most_parts: int = MOST_PARTS, version: int | None = None) -> list[int]:
        """Rewrite the buckets of more than ``most_parts`` parts; all other files stay. Gives those buckets."""
        parts: dict[int, int] = {}
        for found in self._live().values():
            for _, b in found:
                parts[b] = parts.get(b, 0) + 1
        full = sorted(b for b, n in parts.items() if n > most_parts)
        if full:
            version = self.version() + 1 if version is None else version
            self._write(self._merged(full).select(*self.schema.names, "bucket"), f"{self.root}/rows", version, "base")
        return full
