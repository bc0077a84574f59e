"""Article enrichment: reuse, page text, tags, summaries, guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import docs as D
from ..functions import text as X
from ..schemas import BACKEND_ARTICLE_FIELDS, category_names
from .selection import latest

REUSED = ("textcontent", "summary", "tags")


def parse_articles(df: DataFrame, body: str = "body") -> DataFrame:
    """Strict parse of article documents into ``article`` plus the list of bad fields.

    Dates are coerced: numbers are epoch milliseconds, booleans 0 or 1 of them, JSON
    null is the epoch; a missing or unreadable date is an error. Optional fields may be
    missing but not null. Unknown keys are dropped.
    """
    out = df.withColumn("_doc", F.try_parse_json(F.col(body)))
    doc = F.col("_doc")
    values, bad = {}, []
    for name, declared in BACKEND_ARTICLE_FIELDS.items():
        k, raw = D.kind(doc, name), D.field(doc, name)
        if declared == "timestamp!":
            millis = F.try_variant_get(doc, f"$.{name}", "double")
            value = F.when(k == "VOID", F.timestamp_millis(F.lit(0))) \
                .when(k == "STRING", D.timestamp_of(D.text_of(doc, name))) \
                .when(k == "BOOLEAN", F.timestamp_millis(
                    F.try_variant_get(doc, f"$.{name}", "boolean").cast("long"))) \
                .when(millis.isNotNull(), F.timestamp_millis(millis.cast("long")))
            wrong = value.isNull()
        elif declared == "array<string>":
            value = F.try_variant_get(doc, f"$.{name}", declared)
            empty = F.coalesce(F.to_json(raw) == "[]", F.lit(False))
            wrong = k.isNotNull() & (k != "ARRAY<STRING>") & ~empty
        else:
            value = D.text_of(doc, name)
            wrong = F.coalesce(k, F.lit("absent")) != "STRING"
            wrong = wrong if declared.endswith("!") else wrong & k.isNotNull()
        values[name] = value
        bad.append(F.when(wrong, F.lit(name)))
    bad.append(F.when(D.has_key(doc, "_id"), F.lit("_id")))  # ids are set by the store only
    whole = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    problems = F.when(whole, F.array_compact(F.array(*bad))).otherwise(F.array(F.lit("body")))
    article = F.struct(*[v.alias(n) for n, v in values.items()])
    return out.select(*df.columns, problems.alias("problems"),
                      F.when(F.size(problems) == 0, article).alias("article"))


def to_user_article(articles: DataFrame) -> DataFrame:
    """Reader-side copy of a backend article, unread and unjudged."""
    return articles.select(
        "feedurl", "title", "summary", F.col("link").alias("href"), F.lit(False).alias("isread"),
        F.lit(False).alias("issaved"), F.lit(None).cast("boolean").alias("isliked"), "createdat",
        "updatedat", F.col("pubdate").alias("date"), "content", "tags",
        *[c for c in ("image", "duration") if c in articles.columns])


def processed(articles: DataFrame) -> DataFrame:
    """Per link the latest article that has text, summary and tags."""
    done = articles.where(" and ".join(f"{c} is not null" for c in REUSED))
    return latest(done.select("link", "updatedat", "feedurl", *REUSED), ["link"], ["updatedat", "feedurl"])


def reuse_processed(articles: DataFrame, known: DataFrame) -> DataFrame:
    """Copy text, summary and tags from an earlier article with the same link, any feed.

    ``reused`` tells hits from articles still to be enriched.
    """
    hit = processed(known).select(F.col("link").alias("_link"), F.struct(*REUSED).alias("_hit"))
    joined = articles.join(hit, F.col("link") == F.col("_link"), "left")
    return joined.select(
        *[F.coalesce(F.col(f"_hit.{c}"), F.col(c)).alias(c) if c in REUSED else F.col(c)
          for c in articles.columns],
        F.col("_hit").isNotNull().alias("reused"))


def page_text(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Set ``textcontent`` from crawled pages (url, content_type, html).

    A missing page, another content type or too short a text leaves the article as it is.
    """
    usable = pages.where(X.fetchable(F.col("content_type"), F.col("html")))
    text = latest(usable.select("url", "html", "content_type"), ["url"], ["html"]).select(
        F.col("url").alias("_url"), X.long_enough(X.html_to_text(F.col("html"))).alias("_text"))
    joined = articles.join(text, F.col("link") == F.col("_url"), "left")
    return joined.withColumn("textcontent", F.coalesce("_text", "textcontent")).drop("_url", "_text")


def tag_and_summarise(articles: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Built-in tags and summary from columns alone. Articles without text stay as they are."""
    tags = X.keyword_tags(F.col("title"), F.col("textcontent"), names or category_names())
    summary = X.usable_summary(X.extractive_summary(F.col("title"), F.col("textcontent")))
    return articles.withColumns({
        "tags": F.coalesce(F.when(F.size(tags) > 0, tags), F.col("tags")),
        "summary": F.coalesce(summary, F.col("summary"))})


Provider = Callable[[str, str], str]


def generate(df: DataFrame, rules: str, content: str, provider: Provider, out: str) -> DataFrame:
    """Call an outside text provider ``(rules, content) -> text`` once per row.

    The calls run inside tasks, one Arrow batch at a time. A row without content is
    not sent and gets null; a failed call gives "".
    """
    def answer(system: str, text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return (provider(system, text) or "").strip()
        except Exception:  # a provider may fail in any way; the article then stays unchanged
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [answer(r, c) for r, c in zip(batch[rules], batch[content])]
            yield batch.assign(**{out: pd.Series(replies, index=batch.index, dtype="object")})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInPandas(run, schema)


def enrich_with_provider(articles: DataFrame, pages: DataFrame, provider: Provider,
                         names: list[str] | None = None) -> DataFrame:
    """Text, tags and summary from a text provider, with the same guards as the built-in way."""
    names = names or category_names()
    title, text = F.col("title"), F.col("textcontent")
    usable = pages.where(X.fetchable(F.col("content_type"), F.col("html")))
    raw = latest(usable.select("url", "html"), ["url"], ["html"]).select(
        F.col("url").alias("_url"), X.html_to_text(F.col("html")).alias("_raw"))
    df = articles.join(raw, F.col("link") == F.col("_url"), "left")

    def ask(df: DataFrame, rules, content, out: str) -> DataFrame:
        return generate(df.withColumns({"_rules": rules, "_content": content}), "_rules", "_content",
                        provider, out)

    df = ask(df, F.lit(X.EXTRACT_RULES), F.when(X.filled(F.col("_raw")), F.col("_raw")), "_extract")
    df = df.withColumn("textcontent", F.coalesce(X.long_enough(F.col("_extract")), text))
    df = ask(df, F.lit(X.TAG_RULES), F.when(X.filled(text), X.tag_request(title, text, names)), "_tags")
    df = ask(df, X.summary_rules(title), F.when(X.filled(text), text), "_summary")
    tags = X.parse_tags(F.col("_tags"), names)
    return df.withColumns({
        "tags": F.coalesce(F.when(F.size(tags) > 0, tags), F.col("tags")),
        "summary": F.coalesce(X.usable_summary(F.col("_summary")), F.col("summary")),
    }).select(*articles.columns)


def commit_ready(articles: DataFrame) -> DataFrame:
    """Articles complete enough to be written back. An empty tag list is complete."""
    return articles.where(X.filled(F.col("textcontent")) & X.filled(F.col("summary"))
                          & F.col("tags").isNotNull())


def enrich(articles: DataFrame, known: DataFrame, pages: DataFrame,
           provider: Provider | None = None) -> DataFrame:
    """Reuse earlier work where there is some; enrich only the rest."""
    looked_up = reuse_processed(articles, known)
    todo = looked_up.where(~F.col("reused")).drop("reused")
    if provider is None:
        fresh = tag_and_summarise(page_text(todo, pages))
    else:
        fresh = enrich_with_provider(todo, pages, provider)
    return looked_up.where("reused").drop("reused").unionByName(fresh)
