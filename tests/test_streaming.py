"""Streaming jobs over folders of envelopes, run until the queue is empty."""

import json
from dataclasses import replace
from datetime import datetime as dt

import pytest

from pressroom.operators import linear as L
from pressroom.operators.enrich import generate
from pressroom.schemas import USER_ARTICLE_DOC
from pressroom.sources import queue as Q
from pressroom.sources import tables, versions
from pressroom.sources.keyed import KeyedTable
from pressroom.streaming import jobs as J

from test_models import DDL, training

FAST = replace(L.SETTINGS, max_epochs=20, eta0=0.1)


def put(folder, name, messages):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"Records": [{"messageId": m, "body": b if isinstance(b, str) else json.dumps(b),
                                      "attributes": {"ApproximateReceiveCount": "1", "SentTimestamp": str(1704067200000 + i)}}]})
             for i, (m, b) in enumerate(messages)]
    (folder / name).write_text("\n".join(lines))


def drain(spark, tmp_path, job, queue, handler):
    # failed messages come back on the queue, so run until nothing is left to read
    for _ in range(Q.MAX_RECEIVES):
        q = J.run(Q.read_queue(spark, str(queue)), handler, job, str(queue), str(tmp_path / "rejects"), str(tmp_path / f"cp-{job}"))
        q.awaitTermination()


def event(user="u1", op="update", **change):
    doc = {"_id": "a1", "userId": user, "feedUrl": "f", "href": "h", "title": "rocket to space", "summary": "orbit", "tags": ["x"],
           "isRead": False, "isSaved": False, "isLiked": None, **change}
    return {"operationType": op, "fullDocument": doc}


def test_route_train_score(spark, tmp_path):
    events, train_q, score_q = (tmp_path / n for n in ("events", "train", "score"))
    put(events, "one.json", [("m1", event(isLiked=True)), ("m1", event(isLiked=True)), ("m2", event()), ("m3", event(op="insert")),
                             ("m4", "{bad"), ("m5", event(score={"like": 1})), ("m6", event(user="u2", isSaved=True)),
                             ("m7", event(user="stranger"))])
    drain(spark, tmp_path, "router", events, J.router(str(tmp_path / "log"), str(train_q), str(score_q)))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.message_id for r in log.collect()) == ["m1", "m2", "m3", "m5", "m6", "m7"]
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert [(r.job, r.message_id, r.receives, r.error) for r in rejects] == [("router", "m4", 5, "invalid json")]

    store = str(tmp_path / "models")
    rows = spark.createDataFrame(training(), DDL)
    drain(spark, tmp_path, "trainer", train_q, J.trainer(spark, store, lambda: rows, FAST))
    cold = {r.userid: r for r in versions.load_models(spark, store).meta.collect()}
    assert {u: (r.status, r.labeled_count) for u, r in cold.items()} == {"u1": ("trained", 16), "u2": ("trained", 16)}
    put(train_q, "later.json", [("m8", event(isLiked=False)["fullDocument"]), ("m9", event(isRead=True)["fullDocument"])])
    drain(spark, tmp_path, "trainer", train_q, J.trainer(spark, store, lambda: rows, FAST))
    warm = {r.userid: r for r in versions.load_models(spark, store).meta.collect()}
    assert (warm["u1"].labeled_count, warm["u1"].neutral_count, warm["u2"].labeled_count) == (17, 9, 16)
    assert warm["u1"].dislike_b != cold["u1"].dislike_b and warm["u2"].dislike_b == cold["u2"].dislike_b

    root = str(tmp_path / "articles")
    docs = spark.createDataFrame([("a1", "t", "h"), ("a2", "t", "h")], "_id string, title string, href string")
    for f in USER_ARTICLE_DOC.fields:
        if f.name not in docs.columns:
            docs = docs.selectExpr("*", f"cast(null as {f.dataType.simpleString()}) as {f.name}")
    KeyedTable.create(docs.select(USER_ARTICLE_DOC.names), root, ["href"], J.READER)
    drain(spark, tmp_path, "scorer", score_q, J.scorer(spark, store, root, str(tmp_path / "outcomes")))
    got = {r["_id"]: r.score for r in KeyedTable(spark, root).read().collect()}
    assert got["a2"] is None and got["a1"].like + got["a1"].neutral + got["a1"].dislike == pytest.approx(1.0)
    # no model is a result: noted once, neither sent again nor rejected
    noted = spark.read.parquet(str(tmp_path / "outcomes")).where("status = 'no_model'").collect()
    assert [r.message_id for r in noted] == ["m7"]
    assert spark.read.parquet(str(tmp_path / "rejects")).where("job = 'scorer'").isEmpty()


LONG = "The space rocket reached orbit after a long security check. Nothing else was said about it at all. " * 3


def article(link, **change):
    return {"feedUrl": "f", "title": "Space rocket in orbit", "link": link, "content": "c", "createdAt": "2024-01-01T00:00:00Z",
            "updatedAt": "2024-01-01T00:00:00Z", "pubDate": "2024-01-01T00:00:00Z", **change}


def stores(spark, tmp_path):
    backend, reader = str(tmp_path / "backend"), str(tmp_path / "reader")
    ddl = ("_id string, feedurl string, link string, title string, updatedat timestamp, textcontent string, summary string, tags array<string>")
    KeyedTable.create(spark.createDataFrame([
        ("b1", "f", "new", "t", dt(2023, 1, 1), None, None, None), ("b2", "other", "known", "t", dt(2023, 1, 1), "text", "done before", ["Video"]),
        ("b3", "f", "known", "t", dt(2023, 1, 1), None, None, None), ("b4", "f", "short", "t", dt(2023, 1, 1), None, None, None)], ddl), backend, ["link"], J.BACKEND)
    KeyedTable.create(spark.createDataFrame([
        (1, "f", "new", None, None, dt(2023, 1, 1)), (2, "f", "new", None, None, dt(2023, 1, 1)), (3, "f", "known", None, None, dt(2023, 1, 1)),
        (4, "other", "known", None, None, dt(2023, 1, 1)), (5, "f", "short", None, None, dt(2023, 1, 1))],
        "id int, feedurl string, href string, summary string, tags array<string>, updatedat timestamp"), reader, ["href"],
        {"enriched": J.READER["enriched"]})
    pages = spark.createDataFrame([("new", "text/html", f"<html><body><p>{LONG}</p></body></html>"), ("short", "text/html", "<p>too short</p>")],
                                  "url string, content_type string, html string")
    return backend, reader, pages


def test_enrich(spark, tmp_path):
    backend, reader, pages = stores(spark, tmp_path)
    queue, archive = tmp_path / "queue", str(tmp_path / "archive")
    put(queue, "q.json", [("m1", article("new")), ("m2", article("known")), ("m3", article("short")), ("m4", {"title": "incomplete"})])
    drain(spark, tmp_path, "enrich", queue, J.enricher(spark, backend, reader, archive, lambda: pages))
    b = {r["_id"]: r for r in KeyedTable(spark, backend).read().collect()}
    assert b["b1"].tags == ["Security", "Space"] or b["b1"].tags == ["Space", "Security"]
    assert b["b1"].summary.startswith("The space rocket reached orbit")
    assert (b["b3"].summary, b["b3"].textcontent, b["b2"].summary, b["b4"].summary) == ("done before", "text", "done before", None)
    r = {x.id: x for x in KeyedTable(spark, reader).read().collect()}
    assert r[1].summary == r[2].summary == b["b1"].summary and r[3].tags == ["Video"] and r[5].summary is None
    assert r[4].summary == "done before"  # a row that had missed its update
    stored = {x.link for x in tables.lower_names(spark.read.parquet(archive)).collect()}
    assert stored == {"new", "known", "short"}  # archived even if incomplete
    assert [x.error for x in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["feedUrl,link,content,createdAt,updatedAt,pubDate"]


def test_rows_added_later_are_filled(spark, tmp_path):
    """A reader row that comes after its article was enriched is filled by the next batch, whatever that is about."""
    backend, reader, pages = stores(spark, tmp_path)
    queue, archive = tmp_path / "queue", str(tmp_path / "archive")
    put(queue, "q.json", [("m1", article("new"))])
    handler = J.enricher(spark, backend, reader, archive, lambda: pages)
    drain(spark, tmp_path, "enrich", queue, handler)
    table = KeyedTable(spark, reader)
    table.append(spark.createDataFrame([(9, "f", "new", None, None, dt(2024, 1, 1)), (10, "f", "unknown", "", None, dt(2024, 1, 1))], table.schema))
    put(queue, "r.json", [("m2", article("short"))])
    drain(spark, tmp_path, "enrich", queue, handler)
    r = {x.id: x for x in KeyedTable(spark, reader).read().collect()}
    assert r[9].summary == r[1].summary and r[9].summary.startswith("The space rocket") and r[10].summary == ""


def test_enrich_with_provider(spark, tmp_path):
    def provider(rules, content):
        if rules.startswith("Keep only"):
            return content.strip()
        if rules.startswith("Choose"):
            if "kaputt" in content:
                raise RuntimeError("no answer")
            return '["space", "Nonsense", "AI"]'
        return "A summary of some length that says what it is about, word for word."

    from pressroom.operators import enrich as E
    ddl = "link string, title string, textcontent string, summary string, tags array<string>"
    pages = spark.createDataFrame([(k, "text/html", f"<p>{LONG}</p>") for k in ("a", "b")], "url string, content_type string, html string")
    articles = spark.createDataFrame([("a", "fine", None, None, None), ("b", "kaputt", None, None, ["Old"]), ("c", "no page", None, None, None)], ddl)
    got = {r.link: r for r in E.enrich_with_provider(articles, pages, provider).collect()}
    assert got["a"].tags == ["Space", "AI"] and got["a"].summary.startswith("A summary") and got["a"].textcontent == LONG.strip()
    assert got["b"].tags == ["Old"] and got["b"].summary.startswith("A summary")
    assert (got["c"].textcontent, got["c"].summary, got["c"].tags) == (None, None, None)


def test_provider_is_not_called_without_content(spark):
    df = spark.createDataFrame([("r", None), ("r", "x")], "rules string, content string")
    assert [r.out for r in generate(df, "rules", "content", lambda r, c: c * 2, "out").collect()] == [None, "xx"]


def test_failed_messages_come_again_after_the_delay(spark, tmp_path):
    """Five attempts, each the delay after the one before; the wait goes on over restarts of every job."""
    import time

    delay, queue, held, attempts = 3.0, tmp_path / "queue", str(tmp_path / "held"), []
    put(queue, "one.json", [("bad", "x"), ("good", "y")])

    def handler(batch, batch_id):
        got = {r.message_id: r.receives for r in batch.collect()}
        if "bad" in got:
            attempts.append((got["bad"], time.time()))
        assert got.keys() <= {"bad"} or attempts[0][0] == got["bad"] == 1  # what was handled never comes again
        return batch.where("message_id = 'bad'").selectExpr("message_id", "'no' as error")

    end = time.time() + 90
    while len(attempts) < Q.MAX_RECEIVES and time.time() < end:
        J.run(Q.read_queue(spark, str(queue)), handler, "j", str(queue), str(tmp_path / "rejects"), str(tmp_path / "cp"),
              held=held, delay=delay).awaitTermination()
        Q.redeliver(spark, held, str(queue), str(tmp_path / "cp-held"), every=None).awaitTermination()
    assert [n for n, _ in attempts] == [1, 2, 3, 4, 5]
    assert all(b - a >= delay for (_, a), (_, b) in zip(attempts, attempts[1:]))
    assert [(r.message_id, r.receives) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [("bad", 5)]


def test_held_messages_need_no_other_message(spark, tmp_path):
    """A running redelivery releases by its timer; copies of a message come back once."""
    import time

    held, queue = str(tmp_path / "held"), tmp_path / "queue"
    m = spark.createDataFrame([("m", "body", 2, dt(2024, 1, 1)), ("m", "body", 3, dt(2024, 1, 1))],
                              "message_id string, body string, receives int, sent_at timestamp")
    Q.hold(m, held, "b", delay=4)
    start = time.time()
    q = Q.redeliver(spark, held, str(queue), str(tmp_path / "cp"), every="200 milliseconds")
    while not queue.exists() and time.time() < start + 40:
        time.sleep(0.2)
    time.sleep(1)
    q.stop()
    back = Q.envelopes(spark.read.option("recursiveFileLookup", True).text(str(queue))).collect()
    assert [(r.message_id, r.body, r.receives, r.sent_at) for r in back] == [("m", "body", 3, dt(2024, 1, 1))]


def test_counts_survive_a_restart(spark, tmp_path):
    queue, cp = tmp_path / "queue", str(tmp_path / "cp")
    doc = lambda **c: event(**c)["fullDocument"]

    def counts():
        J.count_interactions(Q.read_queue(spark, str(queue)), cp).awaitTermination()
        return {r.userid: (r.labeled_count, r.neutral_count) for r in J.interaction_counts(spark, cp).collect()}

    put(queue, "a.json", [("m1", doc(isLiked=True)), ("m2", doc()), ("m3", doc(user="u2", isLiked=False)), ("m4", "{bad"), ("m5", doc(score=None))])
    assert counts() == {"u1": (1, 2), "u2": (1, 0)}
    put(queue, "b.json", [("m1", doc(isLiked=True)), ("m6", doc(isLiked=False)), ("m7", doc(user="u3"))])  # m1 is delivered again
    assert counts() == {"u1": (2, 2), "u2": (1, 0), "u3": (0, 1)}
    assert counts() == {"u1": (2, 2), "u2": (1, 0), "u3": (0, 1)}
