"""Strict parsing and routing of JSON documents."""

import json

from pyspark.sql import functions as F

from pressroom.operators import enrich as E
from pressroom.operators import routing as G

GOOD = {"feedUrl": "f", "title": "t", "link": "l", "content": "c", "createdAt": "2024-01-01T00:00:00Z",
        "updatedAt": 0, "pubDate": None}


def parse(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = E.parse_articles(spark.createDataFrame(rows, "i int, body string")).orderBy("i").collect()
    return [(list(r["problems"]), r["article"]) for r in out]


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


def test_parse_articles(spark):
    docs = [GOOD, without("title"), {**GOOD, "title": 5}, without("pubDate"), {**GOOD, "pubDate": "never"},
            {**GOOD, "image": None}, {**GOOD, "tags": []}, {**GOOD, "tags": ["a", 1]}, {**GOOD, "tags": [None]},
            {**GOOD, "_id": "x"}, {**GOOD, "extra": {}}, "{broken", "[1]", {**GOOD, "createdAt": True}]
    got = parse(spark, docs)
    assert [p for p, _ in got] == [[], ["title"], ["title"], ["pubDate"], ["pubDate"], ["image"], [], ["tags"], ["tags"],
                                   ["_id"], [], ["body"], ["body"], []]
    first = got[0][1]
    assert str(first["pubDate"]) == str(first["updatedAt"]) and first["tags"] is None
    assert got[6][1]["tags"] == []


def route(spark, events):
    rows = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "i int, body string")
    return [(r["collection"], r["route"], r["problem"]) for r in
            G.with_route(G.read_events(df)).orderBy("i").collect()]


def test_routes(spark):
    base = {"userId": "u", "feedUrl": "f", "title": "t", "summary": "s", "tags": [], "isRead": False, "isSaved": False,
            "isLiked": None}

    def update(**change):
        doc = {k: v for k, v in {**base, **change}.items() if v != "absent"}
        return {"operationType": "update", "fullDocument": doc}

    cases = [
        (update(), "score"), (update(tags="absent"), "skip_incomplete"), (update(summary=""), "skip_incomplete"),
        (update(score={}), "skip_scored"), (update(score=None), "score"), (update(isLiked=False), "train"),
        (update(isSaved=True, score={"like": 1}), "train"), (update(isRead=True), "train"),
        (update(isRead=True, action=None), "train"), (update(isRead=True, action="markAllAsRead"), "score"),
        (update(isLiked="true"), "score"), (update(feedUrl="absent"), "log_only"), (update(feedUrl=None), "score"),
        ({"operationType": "insert", "fullDocument": base}, "log_only"),
        ({"operationType": "delete", "fullDocument": base}, "log_only"),
        ({"operationType": "update"}, "reject"), ("nonsense{", "reject"), (update(userId="absent"), "reject"),
    ]
    got = route(spark, [e for e, _ in cases])
    assert [r for _, r, _ in got] == [r for _, r in cases]
    assert got[11][0] == "feeds" and got[12][0] == "articles"
    assert [p for _, _, p in got[-3:]] == ["no document", "invalid json", "no user"]
    assert all((r == "reject") == (p is not None) for _, r, p in got)


def test_log_rows_leave_rejects_out(spark):
    df = spark.createDataFrame([(1, '{"operationType":"update","fullDocument":{"userId":"u"}}'), (2, "{")], "id int, body string")
    rows = G.log_rows(G.read_events(df).withColumn("at", F.lit("2024-05-06 07:08:09.123456").cast("timestamp")), "at", "id").collect()
    assert len(rows) == 1 and rows[0]["event_key"].startswith("feeds/u/update/2024/05/06/1714979289123-")
    assert json.loads(rows[0]["document"]) == {"userId": "u"}


def test_summaries_of_a_query_are_made_once(spark):
    """Queries that read the articles several times summarise them once, into a table in the shared folder."""
    from pressroom.plans import queries as Q

    for name in ("merge_backend", "retag_merge", "late_enrichment", "merge_user"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "Generate explode" not in plan, name
