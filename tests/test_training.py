"""Training rows, selection and balancing, against plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressroom.operators import enrich as E
from pressroom.operators import merge as M
from pressroom.operators import training as R
from pressroom.operators.selection import latest, mark_smallest


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_labels(spark):
    pairs = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(pairs, "isliked boolean, issaved boolean")
    got = {(r.isliked, r.issaved): r.y for r in R.with_label(df).collect()}
    for liked, saved in pairs:
        want = 1 if saved is not False else 0 if liked is None else 1 if liked else -1
        assert got[liked, saved] == want


def test_training_filter_and_distinct(spark):
    logged = [("h", f"t{i}", "u", False, liked, action, "x") for i, (liked, action) in enumerate(
        (a, b) for a in (None, True, False) for b in (None, "markAllAsRead", "read"))]
    u = spark.createDataFrame(logged * 3, "href string, title string, userid string, issaved boolean, isliked boolean, action string, summary string")
    # five copies of one article, two summaries
    b = spark.createDataFrame([("h", s) for s in ("s1", "s1", "s2", "s2", None, None)] + [("other", "s3")], "link string, summary string")
    rows = R.training_rows(u, b).collect()
    assert len(rows) == 8 * 3
    assert not [r for r in rows if r.isliked is None and r.action == "markAllAsRead"]


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_mark_smallest_is_exact(spark, digits):
    # one group holds most rows; every quota from none to all
    data = [("hot", f"k{i}") for i in range(500)] + [(f"g{j}", f"k{i}") for j in range(6) for i in range(j)]
    quotas = {"hot": 137, "g0": 3, "g1": 1, "g2": 0, "g3": 2, "g4": 9, "g5": 5}
    df = spark.createDataFrame(data, "g string, k string").withColumn("d", F.md5("k"))
    got = mark_smallest(df, ["g"], spark.createDataFrame(list(quotas.items()), "g string, quota long"),
                        order=[F.col("d")], buckets=[F.substring("d", 1, digits)]).collect()
    assert len(got) == len(data)
    for g, quota in quotas.items():
        keys = sorted((k for h, k in data if h == g), key=md5)
        assert {r.k for r in got if r.g == g and r.picked} == set(keys[:quota])


def rows_for(spark, spec):
    """spec: user -> list of (isliked, issaved)."""
    data = [(u, f"{u}-{i}", liked, saved) for u, rows in spec.items() for i, (liked, saved) in enumerate(rows)]
    return spark.createDataFrame(data, "userid string, row_key string, isliked boolean, issaved boolean")


NEUTRAL, LIKED, DISLIKED, SAVED = (None, False), (True, False), (False, False), (None, True)


def test_balance(spark):
    spec = {"fewer": [NEUTRAL] * 2 + [LIKED] * 5, "equal": [NEUTRAL] * 3 + [DISLIKED] * 3,
            "more": [NEUTRAL] * 9 + [LIKED, DISLIKED], "none": [NEUTRAL] * 4, "saved": [SAVED] * 3 + [LIKED]}
    got = R.balance_neutral(rows_for(spark, spec)).collect()
    n = Counter((r.userid, r.isliked is None) for r in got)
    assert n == {("fewer", True): 2, ("fewer", False): 5, ("equal", True): 3, ("equal", False): 3, ("more", True): 2,
                 ("more", False): 2, ("none", True): 4, ("saved", True): 1, ("saved", False): 1}


def test_force_missing_class(spark):
    spec = {"liked": [NEUTRAL, LIKED, LIKED], "disliked": [NEUTRAL, DISLIKED], "both": [LIKED, DISLIKED],
            "neither": [NEUTRAL] * 2, "one": [LIKED]}
    forced = R.force_missing_class(R.with_label(rows_for(spark, spec))).collect()
    got = {u: sorted(r.y for r in forced if r.userid == u) for u in spec}
    assert got == {"liked": [-1, 0, 1], "disliked": [0, 1], "both": [-1, 1], "neither": [0, 0], "one": [-1]}
    # the forced row is a labelled one
    assert {r.y for r in forced if r.userid == "liked" and r.isliked is None} == {0}


def test_oversample_gives_equal_classes(spark):
    spec = {"a": [LIKED] * 7 + [NEUTRAL] * 3 + [DISLIKED] * 2, "b": [LIKED] * 4 + [DISLIKED] * 4, "c": [NEUTRAL] * 3}
    got = R.oversample(R.with_label(rows_for(spark, spec))).collect()
    total = Counter()
    for r in got:
        total[r.userid, r.y] += r.copies
    assert total == {("a", 1): 7, ("a", 0): 7, ("a", -1): 7, ("b", 1): 4, ("b", -1): 4, ("c", 0): 3}
    assert {r.userid: r.n for r in got} == {"a": 21, "b": 8, "c": 3}
    copies = [r.copies for r in got if r.userid == "a" and r.y == 0]
    assert sorted(copies) == [2, 2, 3]


def test_holdout_rounds_half_to_even(spark):
    spec = {f"u{n}": [NEUTRAL] * n for n in (1, 2, 3, 5, 10)}
    got = R.holdout_split(rows_for(spark, spec), 0.5).collect()
    assert {u: sum(r.held_out for r in got if r.userid == u) for u in spec} == {"u1": 0, "u2": 1, "u3": 2, "u5": 2, "u10": 5}


def test_row_key_tells_rows_apart(spark):
    data = [("a", "u", False, None, None, "b"), ("a", "u", False, None, "", "b"), ("a:", "u", False, None, None, "b"),
            ("a", "u", False, None, None, None), ("a", "u", False, None, None, ""), ("a", "u", None, False, None, "b")]
    df = spark.createDataFrame(data, "title string, userid string, issaved boolean, isliked boolean, action string, summary string")
    assert R.keyed_rows(df).select("row_key").distinct().count() == len(data)


def test_neutral_skip(spark):
    counts = spark.createDataFrame([("few", 1, 10), ("even", 5, 5)], "userid string, labeled_count long, neutral_count long")
    data = [(u, f"m{i}", y) for u in ("few", "even", "new") for i in range(300) for y in (0, 1)]
    df = spark.createDataFrame(data, "userid string, k string, y int")
    got = R.neutral_skip(df, counts, "k").collect()
    skipped = Counter(r.userid for r in got if r.skip)
    assert set(skipped) == {"few"} and 240 < skipped["few"] < 290
    assert not [r for r in got if r.skip and r.y == 1]


def test_merges(spark):
    target = spark.createDataFrame([(1, "f", "l", "old"), (2, "f", "l", "old"), (3, "g", "l", "old"), (4, "f", "m", "old")],
                                   "id int, feed string, link string, s string")
    updates = spark.createDataFrame([("f", "l", "new", 2), ("f", "l", "stale", 1), ("f", "zz", "new", 1)],
                                    "feed string, link string, s string, at int")
    one = M.one_per_key(updates, ["feed", "link"], ["at"])
    on = {"feed": "feed", "link": "link"}
    assert {r.id: r.s for r in M.update_all(target, one, on, ["s"]).collect()} == {1: "new", 2: "new", 3: "old", 4: "old"}
    assert {r.id: r.s for r in M.update_first(target, one, on, ["s"], "id").collect()} == {1: "new", 2: "old", 3: "old", 4: "old"}
    by_link = M.one_per_key(updates, ["link"], ["at"])
    assert {r.id: r.s for r in M.update_all(target, by_link, {"link": "link"}, ["s"]).collect()} == {1: "new", 2: "new", 3: "new", 4: "old"}


def test_reuse(spark):
    ddl = "link string, feedurl string, updatedat timestamp, textcontent string, summary string, tags array<string>"
    from datetime import datetime as dt
    known = spark.createDataFrame([
        ("l", "a", dt(2024, 1, 1), "t1", "s1", ["x"]), ("l", "b", dt(2024, 1, 2), "t2", "s2", []),
        ("m", "a", dt(2024, 1, 3), "t3", None, ["x"]), ("n", "a", dt(2024, 1, 3), "t4", "s4", None)], ddl)
    new = spark.createDataFrame([(k, "c", dt(2024, 2, 1), None, None, None) for k in "lmnz"], ddl)
    got = {r.link: r for r in E.reuse_processed(new, known).collect()}
    assert (got["l"].reused, got["l"].textcontent, got["l"].summary, got["l"].tags, got["l"].feedurl) == (True, "t2", "s2", [], "c")
    assert not any(got[k].reused for k in "mnz")


def test_commit_ready_accepts_empty_tags(spark):
    df = spark.createDataFrame([("a", "t", "s", []), ("b", "", "s", ["x"]), ("c", "t", "", ["x"]), ("d", "t", "s", None), ("e", None, "s", [])],
                               "link string, textcontent string, summary string, tags array<string>")
    assert [r.link for r in E.commit_ready(df).collect()] == ["a"]


def test_latest_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "c"), ("k", 0, "z"), ("j", 5, "a")], "k string, v int, w string")
    assert {(r.k, r.w) for r in latest(df, ["k"], ["v", "w"]).collect()} == {("k", "c"), ("j", "a")}
