"""Sources, sinks, caches and versioned tables."""

import json
import re
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressroom.operators import linear as L
from pressroom.operators.preference import Models
from pressroom.sources import queue as Q
from pressroom.sources import sinks, tables, versions
from pressroom.sources.keyed import Channel, KeyedTable


def test_camel_case_documents(spark, tmp_path):
    folder = tmp_path / "backend-articles/2024/01/02/key"
    folder.mkdir(parents=True)
    (folder / "backend-article.json").write_text(json.dumps({
        "link": "l", "feedUrl": "f", "textContent": "t", "createdAt": "2024-01-02T03:04:05.678Z", "tags": ["a"], "title": "x"}))
    r = tables.scan_backend_articles(spark, str(tmp_path)).first()
    assert (r.link, r.feedurl, r.textcontent, r.tags, r.createdat) == ("l", "f", "t", ["a"], dt(2024, 1, 2, 3, 4, 5, 678000))
    # a lower-case schema over the same file finds nothing: the reason for reading camel case
    bad = spark.read.schema("feedurl string").option("recursiveFileLookup", True).json(str(tmp_path)).first()
    assert bad.feedurl is None


def test_categories(spark):
    assert tables.categories(spark).count() == 112


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = tables.materialize(spark.range(3), path)
    assert first.count() == 3
    assert tables.materialize(spark.range(9), path).count() == 3
    assert tables.materialize(spark.range(9), path, refresh=True).count() == 9


ARTICLE = "link string, feedurl string, title string, createdat timestamp, updatedat timestamp"


def test_archive_replaces_by_key_and_keeps_the_day(spark, tmp_path):
    path = str(tmp_path / "archive")

    def put(*rows):
        sinks.archive_articles(spark.createDataFrame(list(rows), ARTICLE), path)

    put(("a", "f", "a1", dt(2024, 1, 1), dt(2024, 1, 1)), ("b", "f", "b1", dt(2024, 1, 1), dt(2024, 1, 1)),
        ("c", "f", "c1", dt(2024, 1, 2), dt(2024, 1, 2)))
    put(("a", "f", "a2", dt(2024, 1, 1), dt(2024, 1, 3)), ("d", "f", "d1", dt(2024, 1, 5), dt(2024, 1, 5)))
    put(("a", "f", "older date", dt(2024, 1, 1), dt(2023, 1, 1)), ("a", "e", "oldest", dt(2024, 1, 1), dt(2022, 1, 1)))
    rows = spark.read.parquet(path).collect()
    assert sorted(r.title for r in rows) == ["b1", "c1", "d1", "older date"]
    assert {r.archive_key for r in rows if r.link == "a"} == {"backend-articles/2024/01/01/a/backend-article.json"}


def test_log_replay_replaces_its_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("m1", "articles", "u", "update", "k1", '{"href":"h","feedUrl":"f","isLiked":true}', "2024", "01", "02"),
                                  ("m2", "feeds", "u", "insert", "k2", "{}", "2024", "01", "02")],
                                 "message_id string, collection string, user_id string, operation_type string, event_key string, "
                                 "document string, year string, month string, day string")
    for batch in ("0", "0", "1"):
        sinks.append_log(rows, path, batch)
    assert spark.read.parquet(path).count() == 4
    got = tables.scan_user_articles(spark, path).collect()
    assert len(got) == 2 and got[0].href == "h" and got[0].feedurl == "f" and got[0].isliked is True


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    folder = sinks.snapshot({"t": df, "u": df}, str(tmp_path), dt(2024, 1, 2, 3, 4, 5))
    assert folder.endswith("snapshot_ts=2024-01-02T03-04-05.000000Z")
    back = sinks.read_snapshot(spark, folder, "t", df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current_version(spark, root) is None
    versions.publish(spark.range(2), root, 1)
    two = versions.publish(versions.current(spark, root).union(spark.range(5)), root, 2)
    assert two.count() == 7 and versions.current_version(spark, root) == 2
    versions.publish(spark.range(1), root, 2)
    assert versions.current(spark, root).count() == 1


def test_model_roundtrip(spark, tmp_path):
    root, new = str(tmp_path / "m"), str(tmp_path / "n")

    def models(users, value):
        terms = spark.createDataFrame([(u, "title", "w", 1, 1.0, value, 0.0, 0.0) for u in users],
                                      "userid string, block string, term string, df long, idf double, dislike double, neutral double, like double")
        meta = spark.createDataFrame([(u, 1, 1, "trained", [-1, 0, 1], value, 0.0, 0.0) for u in users],
                                     "userid string, labeled_count long, neutral_count long, status string, classes array<int>, "
                                     "dislike_b double, neutral_b double, like_b double")
        return Models(terms, meta)

    assert versions.load_models(spark, root) is None
    versions.save_models(models(["a", "b"], 1.0), root, 1)
    versions.save_models(models(["b", "c"], 2.0), root, 2)
    versions.save_models(models(["b", "c"], 3.0), root, 2)  # a replay
    m = versions.load_models(spark, root)
    want = {"a": 1.0, "b": 3.0, "c": 3.0}
    assert {r.userid: r.dislike for r in m.terms.collect()} == want == {r.userid: r.dislike_b for r in m.meta.collect()}
    assert {r.userid for r in versions.load_models(spark, root, before=2).meta.collect()} == {"a", "b"}
    one = versions.load_models(spark, root, users=spark.createDataFrame([("a",)], "userid string"))
    assert [r.userid for r in one.meta.collect()] == ["a"] and [r.dislike for r in one.terms.collect()] == [1.0]
    # a batch that moves no coefficient writes no terms, and its reader still finds them
    same = versions.load_models(spark, root, users=spark.createDataFrame([("c",)], "userid string"))
    versions.save_models(Models(same.terms, same.meta.withColumn("neutral_count", F.lit(9).cast("long")), same.terms.limit(0)), root, 3)
    assert not list((tmp_path / "m/terms/version=3").rglob("*.parquet"))
    again = versions.load_models(spark, root)
    assert {r.userid: r.neutral_count for r in again.meta.collect()} == {"a": 1, "b": 1, "c": 9}
    assert {r.userid: r.dislike for r in again.terms.collect()} == want
    plan = versions.load_models(spark, root, users=spark.createDataFrame([("c",)], "userid string")).terms._jdf.queryExecution().toString()
    filters = re.search(r"/terms.*?PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S).group(1)
    assert re.search(r"bucket#\d+ (= \d+|IN \(\d+\))", filters) and re.search(r"version#\d+L? (= 2|IN \(2\))", filters)
    versions.compact_models(spark, root, new)
    assert {r.userid: r.dislike for r in versions.load_models(spark, new).terms.collect()} == want
    assert L.SIDES == ("dislike", "neutral", "like")


def test_envelopes(spark):
    lines = spark.createDataFrame([
        (json.dumps({"Records": [{"messageId": "m1", "body": "{}", "attributes": {"ApproximateReceiveCount": "3", "SentTimestamp": "1000"}},
                                 {"messageId": "m2", "body": "x"}]}),), ("not json",)], "value string")
    got = {r.message_id: r for r in Q.envelopes(lines).collect()}
    assert (got["m1"].receives, got["m1"].sent_at, got["m2"].receives, got["m2"].body) == (3, dt(1970, 1, 1, 0, 0, 1), 1, "x")
    assert len(got) == 3 and any(r.body == "not json" for r in got.values())
    again = Q.envelopes(Q.as_envelopes(Q.envelopes(lines).where(F.col("message_id") == "m1"))).first()
    assert (again.message_id, again.receives, again.body) == ("m1", 3, "{}")


CHANNELS = {"text": Channel(("feed", "link"), ("summary",)), "score": Channel(("id",), ("score",))}


def keyed(spark, path, n=40, buckets=8):
    rows = [(i, f"f{i % 2}", f"l{i // 4}", None, None) for i in range(n)]
    return KeyedTable.create(spark.createDataFrame(rows, "id int, feed string, link string, summary string, score double"),
                             str(path), ["link"], CHANNELS, buckets)


def rows_of(table, buckets=None):
    return {r.id: (r.summary, r.score) for r in table.read(buckets).collect()}


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_keyed_updates_touch_their_buckets_only(spark, tmp_path):
    table = keyed(spark, tmp_path)
    before = files_of(tmp_path)
    touched = table.update("text", spark.createDataFrame([("f0", "l3", "new"), ("f1", "none", "x")], "feed string, link string, summary string"))
    after = files_of(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before  # no file is written again
    added = [f for f in after if f not in before and "/changes/" in f]
    assert len(added) == len(touched) <= 2
    got = rows_of(KeyedTable(spark, str(tmp_path)))
    assert {i for i, (s, _) in got.items() if s} == {12, 14} and len(got) == 40
    # a read of other buckets opens no file of changes
    home = table.buckets_of(spark.createDataFrame([("l3",)], "link string"))
    others = table.read([b for b in range(8) if b not in touched])
    assert not [f for f in others.inputFiles() if "/changes/" in f] and len(rows_of(table, home)) >= 4


def test_keyed_against_whole_table_merges(spark, tmp_path):
    """Updates of both channels, rows added between them, a replay and rewrites give what joins over the whole table give."""
    table = keyed(spark, tmp_path)
    want = {i: [None, None] for i in range(40)}
    links = {i: (f"f{i % 2}", f"l{i // 4}") for i in range(40)}

    def text(rows, version):
        table.update("text", spark.createDataFrame(rows, "feed string, link string, summary string"), version)

    def score(rows):
        table.update("score", spark.createDataFrame(rows, "id int, link string, score double"))

    text([("f0", "l1", "a"), ("f1", "l1", "b"), ("f0", "l2", None)], 1)
    text([("f0", "l1", "a"), ("f1", "l1", "c")], 1)  # the same version again replaces itself
    score([(4, "l1", 0.5), (5, None, 0.25), (99, "l1", 1.0), (98, None, 1.0)])  # two rows are found by their id
    for i, (f, link) in links.items():
        if link == "l1":
            want[i][0] = "a" if f == "f0" else "c"
    want[4][1], want[5][1] = 0.5, 0.25
    assert rows_of(table) == {i: tuple(w) for i, w in want.items()}
    table.append(spark.createDataFrame([(50, "f0", "l1", "own", None), (51, "f0", None, None, None)], table.schema))
    want |= {50: ["own", None], 51: [None, None]}
    assert rows_of(table) == {i: tuple(w) for i, w in want.items()}  # older changes do not reach newer rows
    assert {r.id for r in table.added_since(2).collect()} == {50, 51}
    text([("f0", "l1", "d")], None)
    for i, (f, link) in [*links.items(), (50, ("f0", "l1"))]:
        if (f, link) == ("f0", "l1"):
            want[i][0] = "d"
    before = files_of(tmp_path)
    full = table.compact(most_parts=3)
    assert full and {f: t for f, t in files_of(tmp_path).items() if f in before} == before
    assert rows_of(table) == {i: tuple(w) for i, w in want.items()} and table.compact(most_parts=3) == []
    table.update_first("score", spark.createDataFrame([("f1", "l1", 0.75)], "feed string, link string, score double"), ["feed", "link"])
    want[5][1] = 0.75  # one row of the key, that of the least id
    assert rows_of(table) == {i: tuple(w) for i, w in want.items()}


def test_keyed_channels_share_no_column(spark, tmp_path):
    for bad in ({"a": Channel(("id",), ("score",)), "b": Channel(("link",), ("score",))}, {"a": Channel(("id",), ("link",))}):
        with pytest.raises(ValueError):
            KeyedTable.create(spark.createDataFrame([], "id int, link string, score double"), str(tmp_path), ["link"], bad)
    empty = KeyedTable.create(spark.createDataFrame([], "id int, link string, score double"), str(tmp_path), ["link"],
                              {"a": Channel(("id",), ("score",))})
    assert empty.read().count() == 0 and empty.compact() == [] and empty.version() == 0 or empty.read().columns == ["id", "link", "score"]
