"""Change events: log rows and the route each event takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import docs as D


def read_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Split a message body into operation, document text and document variant.

    ``problem`` says why an event cannot be handled: no valid JSON, no document, no user.
    """
    event = F.try_parse_json(F.col(body))
    document = D.field(event, "fullDocument")
    out = df.withColumns({"_event": event}).withColumns({
        "operation_type": D.text_of(F.col("_event"), "operationType"),
        "doc": D.field(F.col("_event"), "fullDocument"),
    })
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    problem = F.when(F.col("_event").isNull(), "invalid json") \
        .when(~is_object, "no document") \
        .when(~D.truthy(F.col("doc"), "userId"), "no user")
    return out.withColumns({
        "user_id": D.text_of(F.col("doc"), "userId"), "problem": problem,
        "collection": F.when(D.has_key(F.col("doc"), "feedUrl"), "articles").otherwise("feeds"),
    }).drop("_event")


def with_route(events: DataFrame) -> DataFrame:
    """Exactly one route per event.

    Only updates of articles are acted on. Incomplete ones stop; a liked, disliked,
    saved or hand-read article goes to training; what has a score stops; the rest is
    scored. A missing action counts as read by hand.
    """
    doc = F.col("doc")
    complete = D.truthy(doc, "title") & D.truthy(doc, "summary") & D.truthy(doc, "tags")
    judged = D.truthy(doc, "isSaved") | D.is_bool(doc, "isLiked", True) | D.is_bool(doc, "isLiked", False)
    by_hand = D.truthy(doc, "isRead") & ~D.text_of(doc, "action").eqNullSafe("markAllAsRead")
    route = F.when(F.col("problem").isNotNull(), "reject") \
        .when((F.col("collection") != "articles") | ~F.col("operation_type").eqNullSafe("update"), "log_only") \
        .when(~complete, "skip_incomplete") \
        .when(judged | by_hand, "train") \
        .when(D.truthy(doc, "score"), "skip_scored") \
        .otherwise("score")
    return events.withColumn("route", route)


def log_rows(events: DataFrame, at: str, message_id: str) -> DataFrame:
    """Rows of the event log. ``at`` is the processing time."""
    key = D.event_key(F.col("collection"), F.col("user_id"), F.col("operation_type"),
                      F.col(at), F.col(message_id))
    return (events.where(F.col("problem").isNull())
            .select(message_id, "collection", "user_id", "operation_type", key.alias("event_key"),
                    F.to_json("doc").alias("document"),
                    *[v.alias(k) for k, v in D.day_parts(F.col(at)).items()]))


def unscored(articles: DataFrame) -> DataFrame:
    """Articles without a score; an empty score document counts as one."""
    return articles.where(F.col("score").isNull())
