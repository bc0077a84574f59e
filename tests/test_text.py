"""Text expressions on hand-made rows."""

from pyspark.sql import functions as F

from pressroom.functions import docs as D
from pressroom.functions import text as X
from pressroom.schemas import RETAG_CATEGORIES, category_names


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_html(spark):
    deep = "<div>" + "<nav>a" * 6 + "b" + "</nav>" * 6 + "kept</div>"
    cases = {
        "<html><head><title>T</title><style>x</style></head><body><p>one</p> two</body></html>": "one two",
        "<body><NAV class='x'>menu</NAV>text</body>": "text",
        deep: "kept",
        "<p>a<script>if (1 < 2) { '<p>no</p>' }</script>b": "ab",
        "a<!-- <p>gone</p> -->b": "ab",
        "<p>&lt;b&gt; &amp;lt; &#39;&#x27;&nbsp;&eacute;&bogus; &#0;": "<b> &lt; '' é&bogus; �",
        "<p>see https://ex.test/a?b=c#d now</p>": "see now",
        "<p>a &lt; b and 3 < 4</p>": "a < b and 3 < 4",
        "<select><option>a<option>b</select>c": "c",
        "<dl><dt>k<dd>v<dt>l<dd>w</dl>end": "klend",
        "<form>lost</form><object><object>x</object>y</object>z": "z",
        "x<nav>unclosed": "xunclosed",
        "x" + "<nav>a" * 12 + "</nav>b" * 12 + "y": "xby",
        "x<form>a<nav>b<nav>c<svg>d</svg>e</nav>f</nav>g": "xag",
        "x</nav>y<nav>a<nav>b<nav>c</nav></nav></nav></nav>z": "xyz",
        "<svg width='1'/>after<svg><title>t</title></svg>": "after",
        "<b>x</b><br><img src='a.png'><input value=1>y": "xy",
        "  a \n\tb ": " a b ",
        "<p>x<script>never closed": "x",
    }
    assert values(spark, list(cases), X.html_to_text) == list(cases.values())


def test_entities_against_brute_force(spark):
    """Every name of the HTML 5 table, with and without its semicolon, before a letter, a sign and the end."""
    from html import unescape
    from html.entities import html5

    names = sorted({n.rstrip(";") for n in html5})
    texts = [f"a&{n}; &{n}x&{n}=&{n}" for n in names]
    texts += ["&#65;&#x41;&#65&#x41 &#128;&#x9f;&#0;&#xD800;&#1114112;&#99999999999999999999;", "&", "&&amp;amp;", "&;", "&#;&#x;",
              "&amp&lt&notit;&notin;&ampamp;", "no reference", "", "x&AMP;y&Amp;z", "&" * 50 + "lt;", "&#00000000000000065;"]
    # numbers that stand for no character a browser drops none of: only there the library differs
    assert values(spark, texts, X.decode_entities) == [unescape(t) for t in texts]
    assert values(spark, ["&#x81;&#11;&#xFFFE;", None], X.decode_entities) == ["\x81\x0b\ufffe", None]


def test_guards(spark):
    assert values(spark, ["a" * 99, "a" * 100], X.long_enough) == [None, "a" * 100]
    assert values(spark, ["b" * 49, "b" * 50, " " * 60, ""], X.usable_summary) == [None, "b" * 50, None, None]
    assert values(spark, [None, "", " ", "x"], X.filled) == [False, False, True, True]
    assert values(spark, ["text/plain", "TEXT/HTML", None], lambda t: X.fetchable(t, F.lit("x"))) == [True, False, False]
    assert values(spark, ["", None], lambda t: X.fetchable(F.lit("text/html"), t)) == [False, False]


def test_categories():
    a, b = category_names(), category_names(RETAG_CATEGORIES)
    assert (len(a), len(b), len(set(a) & set(b))) == (112, 118, 95)


def test_parse_tags(spark):
    names = category_names()
    replies = ['["5G"]', "gaming", "GAMING!", "AI, ai, A I", "nothing", "", "Cloud,Video,OS,UI,VR,LLM", '["Middle East"]']
    assert values(spark, replies, lambda t: X.parse_tags(t, names)) == [
        [], ["Gaming"], ["Gaming"], ["AI"], [], [], ["Cloud", "Video", "OS", "UI", "VR"], ["MiddleEast"]]


def test_keyword_tags(spark):
    got = values(spark, ["cloud security cloud", "sports and apps", "", None],
                 lambda t: X.keyword_tags(F.lit("Security news"), t, category_names()))
    assert got == [["Cloud", "Security"], ["Apps", "Sports", "Security"], None, None] \
        or got == [["Security", "Cloud"], ["Apps", "Sports", "Security"], None, None]
    # equal counts go by list position: Cloud comes before Security
    assert got[0] == ["Cloud", "Security"]


def test_ngrams_against_brute_force(spark):
    import re
    texts = ["one two three four five six seven", "a bb", "Été à la plage", "", "x y z", "aa aa aa"]

    def brute(t):
        w = re.findall(r"(?u)\b\w\w+\b", t.lower())
        return sorted(" ".join(w[i:i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))

    got = values(spark, texts, lambda t: X.ngrams(X.tokens(t), F.lit(5)))
    assert [sorted(g) for g in got] == [brute(t) for t in texts]


def test_extractive_summary(spark):
    text = "Nothing here. The red fox ran. Foxes sleep! A red red wall. The fox saw red."
    got = values(spark, ["Red fox", "Zebra", "fox"], lambda t: X.extractive_summary(t, F.lit(text)))
    assert got == ["The red fox ran. A red red wall. The fox saw red.", "Done", "The red fox ran. The fox saw red."]
    assert values(spark, ["x"], lambda t: X.extractive_summary(t, F.lit(None).cast("string"))) == [None]


def test_keys(spark):
    assert values(spark, ["https://ex.test/a?b=é"], D.url_key) == ["https---ex-test-a-b--"]
    day = F.lit("2024-02-03 04:05:06.789").cast("timestamp")
    assert values(spark, ["u v"], lambda t: D.archive_key(day, t)) == ["backend-articles/2024/02/03/u-v/backend-article.json"]
    assert values(spark, ["x"], lambda t: D.iso_timestamp(day)) == ["2024-02-03T04:05:06.789Z"]
