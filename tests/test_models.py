"""Features and models against plain Python, and their properties."""

import math
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressroom.operators import linear as L
from pressroom.operators import preference as P
from pressroom.operators import similarity as S
from pressroom.operators import tfidf as V

TEXTS = {"a": ["red fox runs", "red fox sleeps", "red dog", "cat"], "b": ["red", "", "x y"]}


def grams(text, longest):
    w = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return Counter(" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))


@pytest.mark.parametrize("cap,max_df,sublinear", [(1000, 1.0, False), (3, 0.6, False), (4, 1.0, True)])
def test_tfidf_against_brute_force(spark, cap, max_df, sublinear):
    block = {"title": V.Block(cap, longest=2, max_df=max_df, sublinear=sublinear)}
    data = [(g, f"{g}{i}", t, 1 + i % 2) for g, texts in TEXTS.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "g string, row_key string, title string, copies int")
    n_of = {g: sum(1 + i % 2 for i in range(len(t))) for g, t in TEXTS.items()}
    df = df.withColumn("n", F.when(F.col("g") == "a", n_of["a"]).otherwise(n_of["b"]))
    counts = V.term_counts(df, ["g"], block, carry=["copies", "n"])
    vocab = V.vocabulary(counts, ["g"], block, "copies")
    weights = V.weights(counts, vocab, ["g"], block).collect()

    import hashlib
    want, want_vocab = {}, {}
    for g in TEXTS:
        df_, tf_ = Counter(), Counter()
        for h, _, t, c in data:
            if h == g:
                for term, k in grams(t, 2).items():
                    df_[term] += c
                    tf_[term] += c * k
        kept = [t for t in df_ if df_[t] <= max_df * n_of[g]]
        kept = sorted(kept, key=lambda t: (-tf_[t], hashlib.md5(t.encode()).hexdigest()))[:cap]
        idf = {t: math.log((1 + n_of[g]) / (1 + df_[t])) + 1 for t in kept}
        want_vocab[g] = {t: (df_[t], tf_[t]) for t in kept}
        for h, key, t, _ in data:
            if h == g:
                raw = {x: (1 + math.log(k) if sublinear else k) * idf[x] for x, k in grams(t, 2).items() if x in idf}
                norm = math.sqrt(sum(v * v for v in raw.values()))
                want.update({(key, x): v / norm for x, v in raw.items()})
    got_vocab = defaultdict(dict)
    for r in vocab.collect():
        got_vocab[r.g][r.term] = (r.df, r.tf)
    assert {g: v for g, v in want_vocab.items() if v} == got_vocab
    assert {(r.row_key, r.term): pytest.approx(r.weight) for r in weights} == want


def test_tag_slots(spark):
    rows = spark.createDataFrame([("f", 1, ["ab cd", "x"]), ("f", 2, ["ab"]), ("f", 3, None), ("e", 4, []), ("e", 5, None)],
                                 "g string, row_key int, tags array<string>")
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    counts = V.tag_counts(rows.join(n, "g"), ["g"])
    vocab = V.vocabulary(counts, ["g"], V.TAG_SLOT)
    layout = V.tag_layout(vocab, V.tag_slots(rows, ["g"]), ["g"]).collect()
    # slot 1 holds one-letter text only: a single zero column; no lists at all: one dummy column
    assert {(r.g, r.slot): r.width for r in layout} == {("f", 0): 3, ("f", 1): 1, ("e", -1): 1}
    w = {(r.row_key, r.term): r.weight for r in V.weights(counts, vocab, ["g"], V.TAG_SLOT).collect()}
    assert w[2, "ab"] == pytest.approx(1.0) and len([k for k in w if k[0] == 1]) == 3


def training(users=("u1", "u2"), n=8):
    like = ["space rocket launch", "orbit station space", "rocket engine test", "moon landing space"]
    bad = ["football match score", "league football final", "coach football team", "goal match team"]
    plain = ["city council budget", "weather report today", "local traffic update", "library hours change"]
    rows = []
    for u in users:
        for i in range(n):
            rows.append((f"{like[i % 4]} number{i}", u, False, True, None, f"long text on {like[(i + 1) % 4]}"))
            rows.append((f"{bad[i % 4]} number{i}", u, False, False, None, f"long text on {bad[(i + 1) % 4]}"))
            rows.append((f"{plain[i % 4]} number{i}", u, False, None, "read", f"long text on {plain[(i + 1) % 4]}"))
    return rows


DDL = "title string, userid string, issaved boolean, isliked boolean, action string, summary string"
FAST = replace(L.SETTINGS, max_epochs=60, eta0=0.1)


@pytest.fixture(scope="module")
def models(spark):
    rows = training() + [("only one class", "poor", False, None, None, ""), ("x", "empty", False, True, None, ""),
                         ("y", "empty", False, False, None, None)]
    m = P.train(spark.createDataFrame(rows, DDL), FAST)
    return P.Models(m.terms.cache(), m.meta.cache())


def scores(spark, models, items):
    df = spark.createDataFrame([(u, f"{i}", t, s) for i, (u, t, s) in enumerate(items)],
                               "userid string, row_key string, title string, summary string")
    return [r for r in P.score(df, models).orderBy(F.col("row_key").cast("int")).collect()]


def test_status(models):
    meta = {r.userid: r for r in models.meta.collect()}
    assert {u: r.status for u, r in meta.items()} == {"u1": "trained", "u2": "trained", "poor": "insufficient_labels", "empty": "no_terms"}
    assert (meta["u1"].labeled_count, meta["u1"].neutral_count, list(meta["u1"].classes)) == (16, 8, [-1, 0, 1])


def test_scores_rank_and_sum_to_one(spark, models):
    got = scores(spark, models, [("u1", "rocket to space", "orbit"), ("u1", "football league", "coach team"),
                                 ("u1", "zzz unknown", None), ("poor", "a title", ""), ("nobody", "a title", ""), ("u1", "", "")])
    assert [r.status for r in got] == ["scored", "scored", "scored", "no_model", "no_model", "scored"]
    for r in got:
        if r.status == "scored":
            s = r.score
            assert s.like + s.dislike + s.neutral == pytest.approx(1.0)
            assert s.preferenceScore == pytest.approx(s.like - s.dislike)
    assert got[0].score.preferenceScore > 0.05 and got[1].score.preferenceScore < -0.05
    assert got[2].score.like == pytest.approx(got[5].score.like)


def test_fit_on_a_sample(spark, models):
    """A bounded sample per class fits a model; counts and vocabulary stay those of all rows."""
    rows = spark.createDataFrame(training(("u1",)), DDL)
    m, whole = P.train(rows, FAST, sample_rows=4), P.train(rows, FAST)
    got = scores(spark, m, [("u1", "rocket to space", "orbit"), ("u1", "football league", "coach team")])
    assert got[0].score.preferenceScore > got[1].score.preferenceScore
    assert m.terms.select("block", "term", "df", "idf").exceptAll(whole.terms.select("block", "term", "df", "idf")).isEmpty()
    assert (m.meta.first().labeled_count, m.meta.first().status) == (16, "trained")


def test_one_step_in_closed_form():
    """A single row: shrink, step, pull by the penalty; terms not met only shrink."""
    p = replace(L.SETTINGS, alpha=0.01)
    entry = [dict(block="b", term=t, weight=x, dislike=d, neutral=0.1, like=0.0) for t, x, d in (("s", 0.6, 0.3), ("t", 0.8, -0.2))]
    row = pd.DataFrame([dict(userid="u", y=-1, draw=0.5, entries=entry, status="trained", classes=[-1, 0, 1], labeled_count=2,
                             neutral_count=1, dislike_b=0.1, neutral_b=0.2, like_b=-0.1)])
    out = pd.concat(list(L.learn_in_order(iter([row]), p))).set_index("term")
    margin = 0.6 * 0.3 - 0.8 * 0.2 + 0.1
    step = p.eta0 / (1 + np.exp(margin))
    shrink, due = 1 - 0.85 * p.eta0 * p.alpha, 0.15 * p.eta0 * p.alpha
    assert out.loc["s", "dislike"] == pytest.approx(0.3 * shrink + step * 0.6 - due)
    assert out.loc["t", "dislike"] == pytest.approx(-(abs(-0.2 * shrink + step * 0.8) - due))
    head = out[out.index.isna()].iloc[0]
    assert head.dislike == pytest.approx(0.1 + p.intercept_rate * step) and head.dislike_decay == pytest.approx(shrink)
    assert (head.applied, head.n_labeled, head.n_neutral) == (1, 1, 0)


def test_two_class_model_is_one_sigmoid(spark):
    rows = [r for r in training(("u",)) if r[3] is not None]
    m = P.train(spark.createDataFrame(rows, DDL), FAST)
    assert list(m.meta.first().classes) == [-1, 1]
    good, bad = scores(spark, m, [("u", "rocket to space", "orbit"), ("u", "football league", "coach team")])
    assert good.score.neutral is None and good.score.like + good.score.dislike == pytest.approx(1.0)
    assert good.score.like > 0.5 > bad.score.like


def test_update_moves_towards_the_label(spark, models):
    before = scores(spark, models, [("u1", "football match", "team"), ("u2", "football match", "team")])
    batch = spark.createDataFrame(
        [("u1", f"m{i}", i, "football match", "team", False, True) for i in range(6)]
        + [("nobody", "m9", 9, "t", "s", False, True)],
        "userid string, row_key string, seq int, title string, summary string, issaved boolean, isliked boolean")
    new = P.update(models, batch, replace(L.SETTINGS, eta0=0.5))
    meta = new.meta.collect()
    assert [(r.userid, r.labeled_count, r.neutral_count) for r in meta] == [("u1", 22, 8)]
    assert new.terms.where("userid = 'u1'").count() == models.terms.where("userid = 'u1'").count()
    after = scores(spark, new, [("u1", "football match", "team")])
    assert after[0].score.like > before[0].score.like
    assert before[0].score.like == pytest.approx(before[1].score.like, abs=0.2)


def test_update_does_not_depend_on_batches(spark, models):
    """Any split of the messages gives the same counters, intercepts and coefficients."""
    texts = [("football match", "team"), ("rocket to space", "orbit"), ("zzz", ""), ("football rocket", "coach orbit")]
    rows = [("u1", f"m{i:02d}", i, *texts[i % 4], False, (None, True, False, None, None)[i % 5]) for i in range(30)]
    ddl = "userid string, row_key string, seq int, title string, summary string, issaved boolean, isliked boolean"
    hot = replace(L.SETTINGS, eta0=0.3, alpha=0.01)

    def after(cuts):
        m = models
        for lo, hi in zip([0, *cuts], [*cuts, 30]):
            new = P.update(m, spark.createDataFrame(rows[lo:hi][::-1], ddl), hot)
            m = P.Models(spark.createDataFrame(new.terms.collect(), new.terms.schema),
                         spark.createDataFrame(new.meta.collect(), new.meta.schema))
        return ({(r.block, r.term): [r[s] for s in L.SIDES] for r in m.terms.collect()}, m.meta.first())

    whole, meta = after([])
    assert meta.labeled_count + meta.neutral_count == 24 + 30
    for cuts in ([1], [7, 8, 20]):
        part, other = after(cuts)
        assert part.keys() == whole.keys() and tuple(other)[1:5] == tuple(meta)[1:5]
        assert all(np.allclose(part[k], whole[k], rtol=1e-9, atol=1e-12) for k in whole)
        assert np.allclose([other[f"{s}_b"] for s in L.SIDES], [meta[f"{s}_b"] for s in L.SIDES])


def test_update_with_an_unknown_class_speaks_against_all(spark):
    rows = [r for r in training(("u",)) if r[3] is not None]  # both sides, nothing neutral
    m = P.train(spark.createDataFrame(rows, DDL), FAST)
    before = m.meta.first()
    assert list(before.classes) == [-1, 1]
    batch = spark.createDataFrame([("u", "m1", 1, "football match", "team", False, None)],
        "userid string, row_key string, seq int, title string, summary string, issaved boolean, isliked boolean")
    new = P.update(m, batch)
    after = new.meta.first()
    assert after.like_b < before.like_b and after.neutral_count == before.neutral_count + 1
    assert new.terms.count() == m.terms.count()


def test_identified_counts_twice_when_liked_and_saved(spark):
    rows = spark.createDataFrame([("u", True, True, 0.9, 0.1), ("u", False, False, 0.1, 0.5), ("u", True, None, 0.3, 0.2),
                                  ("u", None, None, 0.9, 0.0)], "userid string, isliked boolean, issaved boolean, like double, dislike double")
    r = P.identified(rows).first()
    assert (r.liked, r.liked_identified, r.disliked, r.disliked_identified) == (3, 2, 1, 1)


def test_evaluate(spark):
    r = P.evaluate(spark.createDataFrame(training(("u",), 12), DDL), 0.25, FAST).collect()
    assert len(r) == 1 and 0 <= r[0].liked_identified <= r[0].liked
    assert r[0].liked + r[0].disliked > 0


def brute_tags(vector, cats, keep=5):
    x = np.array(vector, dtype=float)
    near = [(-round(float(x @ c) / np.linalg.norm(x) / np.linalg.norm(c), 6), pos, name) for pos, name, c in cats if np.any(c)]
    return [name for _, _, name in sorted(near)[:keep]]


@pytest.mark.parametrize("n, block", [(0, 4), (3, 4), (10, 512), (23, 4), (5000, 512)])
def test_nearest_categories_equal_brute_force(spark, n, block):
    """Any number of categories, in clusters, with ties, vectors of norm 0, and articles without a vector."""
    rng = np.random.RandomState(3)
    centres = rng.randn(12, 8) * 3
    data = [(i, f"c{i}", (centres[i % 12] + rng.randn(8) * 0.5).round(2).tolist()) for i in range(n)]
    if n > 20:
        data[7], data[9], data[5] = (7, "c7", data[11][2]), (9, "c9", data[11][2]), (5, "c5", [0.0] * 8)
    cats = spark.createDataFrame(data, "pos int, name string, embedding array<double>")
    vectors = [(centres[i % 12] + rng.randn(8)).tolist() for i in range(60)] + [c[2] for c in data[:12]]
    rows = list(enumerate(vectors)) + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (0, vectors[0])]
    got = S.top_categories(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), cats, block=block).collect()
    assert len(got) == len(rows)
    listed = [(p, m, np.array(v)) for p, m, v in data]
    for r in got:
        usable = r.embedding is not None and np.any(np.nan_to_num(r.embedding))
        assert r.tags == (brute_tags(r.embedding, listed) if usable else None)


def test_far_blocks_stay_shut(spark, monkeypatch):
    rng = np.random.RandomState(5)
    centres = np.eye(8)
    cats = spark.createDataFrame([(i, f"c{i}", (centres[i % 8] + rng.randn(8) * 0.01).tolist()) for i in range(160)],
                                 "pos int, name string, embedding array<double>")
    folder, pivots, blocks = S._in_blocks(cats, 10)
    opened, inner = [], S._open
    monkeypatch.setattr(S, "_open", lambda f, b: opened.append(b) or inner(f, b))
    tags = S._nearest(folder, pivots, blocks, 5).func(iter([pd.Series([centres[0]])]))
    assert all(t in {f"c{i}" for i in range(0, 160, 8)} for t in next(tags)[0])
    assert len(set(opened)) < len(blocks)


def test_retag(spark):
    backend = spark.createDataFrame([("a", "l", "aaa", ["x"]), ("b", "l", "bbb", None), ("c", "m", "  ", ["kept"]), ("d", None, "ab", []), ("e", "n", None, None)],
                                    "_id string, link string, textcontent string, tags array<string>")
    reader = spark.createDataFrame([(1, "l", ["x"]), (2, "l", None), (3, "m", ["kept"]), (4, None, ["kept"]), (5, "zz", None)], "id int, href string, tags array<string>")
    cats = spark.createDataFrame([(0, "b"), (1, "a")], "pos int, name string")
    new, rows = S.retag(backend, reader, cats, lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts])
    assert {r["_id"]: r.tags for r in new.collect()} == {"a": ["a", "b"], "b": ["b", "a"], "c": ["kept"], "d": ["b", "a"], "e": None}
    assert {r.id: r.tags for r in rows.collect()} == {1: ["b", "a"], 2: ["b", "a"], 3: ["kept"], 4: ["kept"], 5: None}


def test_embed(spark):
    df = spark.createDataFrame([("ab",), ("  ",), (None,), ("abc",)], "t string")
    got = S.embed(df, "t", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert sorted((r.t, r.embedding) for r in got) == [("ab", [2.0, 1.0]), ("abc", [3.0, 1.0])]


def test_numbered_vocabulary_equals_counted_one(spark):
    """Caps met in the middle of a frequency, at its end and not at all; empty and repeated texts."""
    rng = np.random.RandomState(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(u, f"{u}{i}", " ".join(rng.choice(words, rng.randint(0, 9))), "same text again" if i % 3 else None or "", int(rng.randint(1, 4)), 50)
            for u in ("a", "b", "c") for i in range(30)]
    df = spark.createDataFrame(rows, "userid string, row_key string, title string, summary string, copies int, n long")
    for most in (7, 40, 10_000):
        blocks = {"title": V.Block(most, longest=3, max_df=0.7), "summary": V.Block(5, longest=2)}
        counts = V.term_counts(df, ["userid"], blocks, carry=["copies", "n"])
        want = V.vocabulary(counts, ["userid"], blocks, "copies").collect()
        got = V.fit_vocabulary(df, ["userid"], blocks, "copies")
        assert got.columns == ["userid", "block", "term", "df", "tf", "idf"]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in got.columns) for r in want)
