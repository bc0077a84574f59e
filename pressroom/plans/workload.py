"""Entity tables laid over the given parquet tables.

Everything follows from the data: copies of a text are one article carried by several
feeds (same link), unlabelled documents are untagged, short ones have no text of their
own, and summaries come from the summariser over the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import docs as D
from ..functions import text as X
from ..session import cut_lineage, widen
from ..operators.training import keyed_rows, training_rows


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in ("documents", "pages"):
        return widen(df)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def _documents(spark: SparkSession, sf: str, summary: bool = True) -> DataFrame:
    """Documents as articles. The summary comes out of a generator, so that no filter on
    it moves down to the scan, where it would be computed a second time."""
    day = F.lit("2024-01-01").cast("timestamp")
    created = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(30)), day)
    text = X.long_enough(F.col("text"))
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    raw = F.explode(F.array(X.extractive_summary(title, text))) if summary else F.lit(None).cast("string")
    return read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("https://ex.test/a/"), F.md5("text")).alias("link"),
        F.concat(F.lit("feed-"), "source").alias("feedurl"), title.alias("title"), F.col("text").alias("content"),
        text.alias("textcontent"), raw.alias("raw_summary"), "lang", "source",
        created.alias("createdat"), F.timestamp_add("DAY", F.lit(1), created).alias("updatedat"),
        created.alias("pubdate"))


def summarised(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles without their raw content, for a query that reads them several times: summaries are made once."""
    return cut_lineage(_documents(spark, sf).drop("content"))


def backend_articles(spark: SparkSession, sf: str, summary: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, link, feedurl, title, content, textcontent, summary, tags and three dates; no content with ``docs`` (``summarised``)."""
    joined = (_documents(spark, sf, summary) if docs is None else docs).join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    tags = F.when(F.col("toxic").isNotNull(), F.array_compact(F.array(
        "lang", "source", F.when(F.col("toxic") == 1, "toxic"))))
    return joined.select("doc_id", "link", "feedurl", "title", *(["content"] if docs is None else []), "textcontent",
                         X.usable_summary(F.col("raw_summary")).alias("summary"), tags.alias("tags"),
                         "createdat", "updatedat", "pubdate")


def user_articles(spark: SparkSession, sf: str, summary: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """The interaction log: every event falls on one document, round the whole collection. ``docs`` as above."""
    content = ["content"] if docs is None else []
    docs = _documents(spark, sf, summary) if docs is None else docs
    n_docs = read(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    events = read(spark, sf, "events").withColumn("doc_id", F.col("event_id") % n_docs)
    kind, value = F.col("event_type"), F.col("value")
    return events.join(docs.drop("createdat", "updatedat", "pubdate"), "doc_id").select(
        "event_id", "doc_id", F.col("link").alias("href"), "feedurl", F.col("user_id").cast("string").alias("userid"),
        "title", *content, X.usable_summary(F.col("raw_summary")).alias("summary"),
        F.col("ts").alias("createdat"), F.col("ts").alias("updatedat"),
        F.when(kind == "purchase", True).when(kind == "error", False).alias("isliked"),
        F.when(value >= 2, kind == "signup").alias("issaved"), kind.isin("view", "click").alias("isread"),
        F.when((kind == "view") & (value < 10), "markAllAsRead").when(kind == "click", "read").alias("action"),
        F.when(value > 30, F.struct(F.lit(0.5).alias("neutral"), F.lit(0.3).alias("like"), F.lit(0.2).alias("dislike"),
                                    F.lit(0.1).alias("preferenceScore"))).alias("score"), value.alias("value"))


def training(spark: SparkSession, sf: str) -> DataFrame:
    return training_rows(user_articles(spark, sf), backend_articles(spark, sf))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return keyed_rows(training(spark, sf))


def change_events(spark: SparkSession, sf: str) -> DataFrame:
    """Change events as JSON: reader articles, and feed records for unpaid sign-ups."""
    u = user_articles(spark, sf, summary=True).join(
        read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    article = F.col("issaved").isNotNull() | F.col("isliked").isNotNull() | F.col("isread")
    doc = F.struct(
        F.col("event_id").cast("string").alias("_id"), F.col("userid").alias("userId"),
        F.when(article, F.col("feedurl")).alias("feedUrl"), F.col("href"), F.col("title"),
        F.when(article, F.col("summary")).alias("summary"), F.col("isread").alias("isRead"),
        F.col("issaved").alias("isSaved"), F.col("isliked").alias("isLiked"), F.col("action"), F.col("score"),
        F.when(article & F.col("toxic").isNotNull(), F.array(F.lit("tag"))).alias("tags"))
    op = F.when(F.col("value") < 5, "insert").otherwise("update")
    return u.select("event_id", F.col("createdat").alias("at"),
                    F.to_json(F.struct(op.alias("operationType"), doc.alias("fullDocument"))).alias("body"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled pages; the content type follows from the kind of address."""
    url = F.col("url")
    kind = F.when(F.contains(url, F.lit("#")), "application/pdf").when(F.contains(url, F.lit("?")), "TEXT/HTML") \
        .otherwise("text/html; charset=utf-8")
    return read(spark, sf, "pages").select("page_id", "url", kind.alias("content_type"), "html")


def article_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as JSON messages, some incomplete, misdated or broken."""
    a = _documents(spark, sf, summary=False).join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    def date(c):
        return D.iso_timestamp(F.col(c))
    mail = F.date_format("pubdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    body = F.to_json(F.struct(
        F.col("feedurl").alias("feedUrl"), F.when(F.col("title") != "", F.col("title")).alias("title"), F.col("link"),
        F.col("content"), F.when(~F.col("toxic").eqNullSafe(F.lit(1)), date("createdat")).alias("createdAt"),
        date("updatedat").alias("updatedAt"),
        F.when(F.col("lang") == "es", "someday").when(F.col("lang") == "de", mail).otherwise(date("pubdate")).alias("pubDate"),
        F.col("textcontent").alias("textContent")))
    return a.select("doc_id", F.when(F.col("textcontent").isNull(), F.concat(F.lit("{"), body)).otherwise(body).alias("body"))
