"""Streaming jobs: route change events, enrich articles, train and score.

Every job handles a micro-batch with the same set-based operators as a batch run and
writes results under the batch id, so a replayed batch replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import docs as D
from ..operators import enrich as E
from ..operators import linear as L
from ..operators import merge as M
from ..operators import preference as P
from ..operators import routing as G
from ..operators import training as R
from ..operators.selection import latest
from ..operators.training import USER
from ..session import cut_lineage
from ..sources import queue as Q
from ..sources import sinks, versions
from ..sources.keyed import Channel, KeyedTable

Handler = Callable[[DataFrame, int], DataFrame]


def run(messages: DataFrame, handler: Handler, job: str, queue: str, rejects: str, checkpoint: str,
        available_now: bool = True, held: str | None = None, delay: float = Q.REDELIVERY_SECONDS) -> StreamingQuery:
    """Run ``handler`` on every micro-batch of a queue.

    Repeated messages of a batch count once. The handler returns the messages it could
    not handle (message_id, error): they come again until they have been received five times,
    then they go to the rejects. With ``held`` they wait there for ``delay`` seconds, and a
    ``queue.redeliver`` over that folder (one that lies outside the queue) brings them back;
    without it they are on the queue again at once.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(latest(batch, ["message_id"], ["receives", "sent_at", "body"]))
        failed = cut_lineage(handler(fresh, batch_id).join(fresh, "message_id"))
        again = failed.where(F.col("receives") < Q.MAX_RECEIVES).withColumn("receives", F.col("receives") + 1)
        if not again.isEmpty():
            if held:
                Q.hold(again, held, f"{job}-{batch_id}", delay)
            else:
                Q.send(again, queue, f"retry-{job}-{batch_id}")
        given_up = failed.where(F.col("receives") >= Q.MAX_RECEIVES)
        if not given_up.isEmpty():
            sinks.reject(given_up.select(F.lit(job).alias("job"), "message_id", "body", "error", "receives"),
                         rejects, str(batch_id))

    writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def count_interactions(messages: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep running counts of labelled and neutral interactions per reader as streaming state; see ``interaction_counts``.

    A message counts once however often it is delivered: ids seen are state too, one short row each. The counts go on
    where they stood after a restart from the checkpoint. Messages without a reader or a title are not counted.
    """
    once = messages.dropDuplicates(["message_id"])
    seen = _interactions(once).where(f"{USER} is not null and title is not null")
    counts = R.with_label(seen).groupBy(USER).agg(  # the state names its values by their functions: sum and count
        F.sum((F.col("y") != 0).cast("long")).alias("labeled_count"), F.count("y").alias("all_count"))
    writer = counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def interaction_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """userid, labeled_count, neutral_count as of the last finished batch, read from the state itself."""
    store = spark.read.format("statestore").option("operatorId", 0).load(checkpoint)
    labelled, everything = F.col("value.sum"), F.col("value.count")
    return store.select(F.col(f"key.{USER}").alias(USER), labelled.alias("labeled_count"), (everything - labelled).alias("neutral_count"))


def router(log: str, train_queue: str, score_queue: str, clock=F.current_timestamp) -> Handler:
    """Log every event under its processing time, then pass it on to training or scoring."""
    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        events = cut_lineage(G.with_route(G.read_events(batch)).withColumn("at", clock())
                             .withColumn("document", F.to_json("doc")).drop("doc"))
        logged = events.withColumn("doc", F.try_parse_json("document"))
        sinks.append_log(G.log_rows(logged, "at", "message_id"), log, str(batch_id))
        for route, queue in (("train", train_queue), ("score", score_queue)):
            out = events.where(F.col("route") == route)
            Q.send(out.select("message_id", F.col("document").alias("body"), F.lit(1).alias("receives"),
                              F.col("at").alias("sent_at")), queue, f"batch-{batch_id}")
        return events.where(F.col("problem").isNotNull()).select("message_id", F.col("problem").alias("error"))

    return handle


def _interactions(batch: DataFrame) -> DataFrame:
    """Reader articles from message bodies, keyed by message."""
    doc = F.try_parse_json("body")

    def text(name: str):
        return F.try_variant_get("_doc", f"$.{name}", "string")

    def flag(name: str):
        return F.try_variant_get("_doc", f"$.{name}", "boolean")

    return batch.withColumn("_doc", doc).select(
        F.col("message_id").alias("row_key"), F.col("sent_at").alias("seq"), text("userId").alias(USER),
        text("_id").alias("id"), text("href").alias("href"), text("title").alias("title"), F.coalesce(text("summary"), F.lit("")).alias("summary"),
        # a missing isSaved is not false, hence counts as liked
        flag("isSaved").alias("issaved"), flag("isLiked").alias("isliked"),
        D.truthy(F.col("_doc"), "score").alias("scored"))


def trainer(spark: SparkSession, store: str, rows: Callable[[], DataFrame], settings: L.Descent = L.SETTINGS,
            from_scratch: bool = False) -> Handler:
    """Update known readers with the messages, train unknown ones on all their training rows.

    A reader known to lack a second class is only counted, until a message brings one.

    ``rows`` gives the training rows of all readers. ``from_scratch`` retrains every reader met.
    """
    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        seen = cut_lineage(_interactions(batch))
        good = seen.where(f"{USER} is not null and title is not null")
        users = good.select(USER).distinct()
        known = versions.load_models(spark, store, before=batch_id + 1, users=users)
        cold, parts = users, []
        if known is not None and not from_scratch:
            # a reader whose rows did not make a model is trained again when a class turns up that it had not
            met = R.with_label(good).groupBy(USER).agg(F.collect_set("y").alias("_met"))
            unfit = known.meta.where("status <> 'trained'").join(met, USER).where(
                F.size(F.array_except("_met", F.coalesce("classes", F.array().cast("array<int>")))) > 0)
            cold = cut_lineage(users.join(known.meta.select(USER), USER, "left_anti").unionByName(unfit.select(USER)))
            parts.append(P.update(known, good.join(cold, USER, "left_anti"), settings))
        if not cold.isEmpty():
            parts.append(P.train(rows().join(cold, USER, "left_semi"), settings))
        if parts:
            versions.save_models(P.together(parts), store, batch_id + 1)
        bad = seen.where(f"{USER} is null or title is null")
        return bad.select(F.col("row_key").alias("message_id"), F.lit("not an article").alias("error"))

    return handle


#: Channels of the two article tables, which lie in buckets by link (``href`` on the reader's side).
BACKEND = {"enriched": Channel(("_id",), ("textcontent", "summary", "tags", "updatedat"))}
READER = {"enriched": Channel(("feedurl", "href"), ("summary", "tags", "updatedat")), "scored": Channel(("_id",), ("score",))}


def scorer(spark: SparkSession, store: str, articles_root: str, outcomes: str | None = None) -> Handler:
    """Score messages without a score and write the scores into the reader articles (a keyed table), by id.

    A batch writes changes into the buckets of its articles; a message without a link is looked up by its id.

    A reader without a model is a result, not a failure: the message is used up. With ``outcomes``
    the status of every message (scored, no_model) is written there under the batch id.
    """
    def note(statuses: DataFrame, batch_id: int) -> None:
        if outcomes:
            statuses.write.mode("overwrite").parquet(f"{outcomes}/batch={batch_id}")

    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        seen = _interactions(batch).where("not scored")
        known = versions.load_models(spark, store, users=seen.where(f"{USER} is not null").select(USER))
        none = seen.where(F.lit(False)).select(F.col("row_key").alias("message_id"), F.lit("").alias("error"))
        if known is None:
            note(seen.select(F.col("row_key").alias("message_id"), F.lit("no_model").alias("status")), batch_id)
            return none
        scored = cut_lineage(P.score(seen.select(USER, "row_key", "title", "summary"), known))
        by_id = seen.select("row_key", F.col("id").alias("_id"), "href", "seq").where("id is not null") \
            .join(scored.where("status = 'scored'"), "row_key")
        updates = cut_lineage(M.one_per_key(by_id.select("_id", "href", "score", "seq", "row_key"), ["_id"], ["seq", "row_key"]))
        note(scored.select(F.col("row_key").alias("message_id"), "status"), batch_id)
        if not updates.isEmpty():
            KeyedTable(spark, articles_root).update("scored", updates)
        return none

    return handle


def fill_late(reader: KeyedTable, backend: KeyedTable, since: int) -> int:
    """Give reader rows added after version ``since`` whose article was enriched before them its summary and tags.

    Only those rows that lack a summary are looked up, in the buckets of their links; gives the version to go on from.
    """
    upto = reader.version()
    lacking = F.coalesce("summary", F.lit("")) == ""
    pending = cut_lineage(reader.added_since(since).where(lacking).select("feedurl", "href").distinct())
    buckets = backend.buckets_of(pending, ["href"])
    if buckets:
        finished = latest(E.commit_ready(backend.read(buckets)).select("feedurl", F.col("link").alias("href"), "summary", "tags", "updatedat"),
                          ["feedurl", "href"], ["updatedat", "summary"])
        found = cut_lineage(finished.join(pending, ["feedurl", "href"], "left_semi"))
        still = reader.read(reader.buckets_of(found)).where(lacking).select("feedurl", "href").distinct()
        found = cut_lineage(found.join(still, ["feedurl", "href"], "left_semi"))
        if not found.isEmpty():
            reader.update("enriched", found)
    return upto


def enricher(spark: SparkSession, backend_root: str, reader_root: str, archive: str, pages: Callable[[], DataFrame],
             provider: E.Provider | None = None, compact: int = 16) -> Handler:
    """Enrich articles, write them back to both tables (keyed by link), archive them.

    A batch opens the buckets of its links only: earlier work is looked up there, changes are written there.
    Rows that readers got since the batch before are looked up once. Buckets of more than ``compact`` parts are rewritten.
    """
    looked: dict[str, int] = {"since": -1}  # a new start looks at all rows once more

    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        backend, reader = KeyedTable(spark, backend_root), KeyedTable(spark, reader_root)
        parsed = cut_lineage(E.parse_articles(batch))
        good = parsed.where("article is not null").select("message_id", "article.*")
        articles = good.select(*[F.col(c).alias(c.lower() if c != "message_id" else c) for c in good.columns])
        known = backend.read(backend.buckets_of(articles))
        done = cut_lineage(E.enrich(articles, known, pages(), provider).withColumn("now", F.current_timestamp()))
        ready = E.commit_ready(done).withColumn("updatedat", F.col("now"))
        updates = cut_lineage(M.one_per_key(
            ready.select("feedurl", "link", "textcontent", "summary", "tags", "updatedat", "message_id"),
            ["feedurl", "link"], ["updatedat", "message_id"]))
        if not updates.isEmpty():
            backend.update_first("enriched", updates, ["feedurl", "link"])
            reader.update("enriched", updates.withColumnRenamed("link", "href"))
        looked["since"] = fill_late(reader, backend, looked["since"])
        for table in (backend, reader):
            table.compact(compact)
        sinks.archive_articles(done.drop("message_id", "now"), archive)
        return parsed.where("article is null").select("message_id", F.array_join("problems", ",").alias("error"))

    return handle
