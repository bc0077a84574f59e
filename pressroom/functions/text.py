"""Text expressions. All run inside the JVM on the row at hand."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements dropped with everything inside them. meta, img, link,
# input and area are dropped too, but hold no text, so losing the tag is enough.
DROPPED = ("dd", "form", "select", "iframe", "canvas", "svg", "map", "nav", "object", "video", "audio")
# Fixed value: what counts as white space (the ECMAScript set).
SPACE = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
# Unicode non-characters stand for the start and end of a dropped element.
OPEN, CLOSE = "\uFDD0", "\uFDD1"
MIN_TEXT = 100
MIN_SUMMARY = 50
WORD = "[\\p{L}\\p{N}_]{2,}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside lambdas, and where the optimizer moves a projection into a filter, an
    expression named twice would be computed twice.
    """
    return F.get(F.transform(F.array(value), body), 0)


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"https?://[^{SPACE}]+", "")


def _references(names: dict[str, str]) -> Column:
    """A map from entity names to their characters; folded to a constant."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _numeric(ref: Column) -> Column:
    """Character of ``#123`` or ``#x7B``; U+FFFD for what is none, 128 to 159 as in Windows-1252."""
    number = F.regexp_replace(F.rtrim(ref, F.lit(";")), "^#[xX]?0*", "")  # more than eight digits are beyond any character
    fits = F.length(number) <= 8
    code = F.when(fits & ref.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), number), 16, 10)) \
        .when(fits, F.concat(F.lit("0"), number)).cast("long")
    remapped = F.create_map(*[F.lit(x) for i in range(0x80, 0xA0) if (c := _windows_1252(i)) for x in (i, c)])
    return _let(code, lambda n: F.coalesce(
        F.when(n.between(0x80, 0x9F), F.try_element_at(remapped, n.cast("int"))),
        F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")),
        F.lit("\uFFFD")))


def _windows_1252(code: int) -> str:
    return bytes([code]).decode("cp1252", "ignore")


def decode_entities(text: Column) -> Column:
    """Replace every character reference once, as a browser reads them in text.

    The text is cut at each "&"; the head of a piece is a number, a name of the HTML 5 table with
    its semicolon, or else the longest prefix that is one of the older names, which need none.
    """
    most_used = {n: html5[n] for n in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")}
    bare = {n: c for n, c in html5.items() if not n.endswith(";")}
    longest, shortest = max(map(len, bare)), min(map(len, bare))

    def bare_prefix(head: Column) -> Column:
        sizes = F.array(*[F.lit(n) for n in range(longest, shortest - 1, -1)])
        tried = F.transform(F.filter(sizes, lambda n: n <= F.length(head)), lambda n: F.substring(head, F.lit(1), n))
        return F.get(F.filter(tried, lambda t: F.try_element_at(_references(bare), t).isNotNull()), 0)

    def decoded(piece: Column) -> Column:
        def by_head(head: Column) -> Column:
            def rest(taken: Column) -> Column:
                return F.substring(piece, F.length(taken) + 1, F.length(piece))

            whole = F.when(head.startswith("#"), _numeric(head)).when(head.endswith(";"), F.coalesce(
                F.try_element_at(_references(most_used), head), F.try_element_at(_references(html5), head)))
            part = _let(bare_prefix(head), lambda p: F.concat(F.try_element_at(_references(bare), p), rest(p)))
            return F.coalesce(F.concat(_let(whole, lambda w: w), rest(head)), part, F.concat(F.lit("&"), piece))

        head = F.regexp_extract(piece, "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)", 1)
        return _let(head, by_head)

    pieces = F.split(text, "&", -1)
    joined = _let(pieces, lambda p: F.concat(F.get(p, 0), F.array_join(
        F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), decoded), "")))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _outside_pairs(page: Column) -> Column:
    """Drop what lies between an OPEN and its CLOSE.

    ``opens`` holds how many pieces were kept when each bracket that is still open came.
    """
    pieces = F.split(page, f"(?=[{OPEN}{CLOSE}])")
    start = F.struct(F.array().cast("array<int>").alias("opens"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, piece: Column) -> Column:
        opens, kept, one = acc["opens"], acc["kept"], F.array(piece)
        n = F.size(opens)
        opened = F.struct(F.concat(opens, F.array(F.size(kept))).alias("opens"), F.concat(kept, one).alias("kept"))
        closed = F.struct(F.slice(opens, F.lit(1), n - 1).alias("opens"),
                          F.concat(F.slice(kept, F.lit(1), F.get(opens, n - 1)), one).alias("kept"))
        plain = F.struct(opens.alias("opens"), F.concat(kept, one).alias("kept"))
        return F.when(piece.startswith(OPEN), opened).when(piece.startswith(CLOSE) & (n > 0), closed).otherwise(plain)

    return F.aggregate(pieces, start, step, lambda acc: F.array_join(acc["kept"], ""))


def html_to_text(html: Column) -> Column:
    """Text of a page body without dropped elements and links, white space collapsed.

    Dropped elements become bracket characters first; what lies between a pair goes,
    however deep it is nested. A tag without its partner loses only the tag.
    """
    names = "|".join(DROPPED)
    page = F.regexp_replace(
        html, "(?is)<!--.*?(?:-->|\\z)|<script(?:\\s[^>]*)?>.*?(?:</script\\s*>|\\z)"
              "|<style(?:\\s[^>]*)?>.*?(?:</style\\s*>|\\z)", "")
    page = F.regexp_replace(page, "(?is)<head(?:\\s[^>]*)?>.*?</head\\s*>", "")
    page = F.regexp_replace(
        page, "(?is)<svg(?:\\s[^>]*)?/>|<option(?:\\s[^>]*)?>[^<]*(?:</option\\s*>)?", "")
    # a <dd> may leave out its end tag: it then ends at the next item or list end
    page = F.when(page.rlike("(?i)<dd[\\s>]") & ~page.rlike("(?i)</dd"), F.regexp_replace(
        page, "(?is)<dd(?:\\s[^>]*)?>.*?(?=<d[dt][\\s>]|</dl\\s*>|\\z)", "")).otherwise(page)
    page = F.regexp_replace(page, f"(?i)<(?:{names})(?:\\s[^>]*|/)?>", OPEN)
    page = F.regexp_replace(page, f"(?i)</(?:{names})\\s*>", CLOSE)
    for _ in range(2):  # most elements are flat and go at once
        page = F.regexp_replace(page, f"{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}", "")
    page = _let(page, lambda p: F.when(F.contains(p, F.lit(CLOSE)), _outside_pairs(p)).otherwise(p))
    page = F.regexp_replace(page, f"[{OPEN}{CLOSE}]|</?[a-zA-Z][^>]*>|<[!?][^>]*>", "")
    return collapse_space(strip_urls(decode_entities(page)))


def fetchable(content_type: Column, body: Column) -> Column:
    """Only textual responses with a body are read (the test is case-sensitive)."""
    kind = F.contains(content_type, F.lit("text")) | F.contains(content_type, F.lit("html"))
    return F.coalesce(kind & (F.length(body) > 0), F.lit(False))


def long_enough(text: Column) -> Column:
    return _let(text, lambda t: F.when(F.length(t) >= MIN_TEXT, t))


def usable_summary(summary: Column) -> Column:
    return _let(summary, lambda s: F.when((F.trim(s) != "") & (F.length(s) >= MIN_SUMMARY), s))


def filled(text: Column) -> Column:
    """A string that is neither missing nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def tokens(text: Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def ngrams(words: Column, longest: Column) -> Column:
    """All runs of 1..longest words, joined by one blank."""
    def runs(w: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(longest, F.size(w)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(
            F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))

    return _let(words, lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<string>")))


def sentences(text: Column) -> Column:
    """Sentences with their closing marks, white space collapsed, blank ones left out."""
    parts = F.regexp_extract_all(text, F.lit("[^.!?\\n]+[.!?]*"), 0)
    return F.filter(F.transform(parts, lambda s: F.trim(collapse_space(s))), lambda s: s != "")


def extractive_summary(title: Column, text: Column, keep: int = 3) -> Column:
    """The ``keep`` sentences sharing most words with the title, in text order.

    The whole text is read. A text unrelated to its title gives "Done", which the
    summary guard then turns down.
    """
    scored = _let(F.array_distinct(tokens(title)), lambda title_words: F.transform(sentences(text), lambda s, i: F.struct(
        (-F.size(F.array_intersect(title_words, tokens(s)))).alias("rank"), i.alias("pos"), s.alias("s"))))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["rank"] < 0)), 1, keep)
    in_order = F.array_sort(F.transform(best, lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"))))
    joined = F.array_join(F.transform(in_order, lambda x: x["s"]), " ")
    return F.when(filled(text), _let(joined, lambda j: F.when(j != "", j).otherwise(F.lit("Done"))))


def parse_tags(reply: Column, names: list[str], keep: int = 5) -> Column:
    """Category names found in a comma-separated reply, first five, without repeats.

    Everything but letters is dropped from each part of the reply, and only from
    the reply: a name holding a digit can never be met.
    """
    by_lower: dict[str, str] = {}
    for name in names:
        by_lower.setdefault(name.lower(), name)
    known = F.create_map(*[F.lit(x) for pair in by_lower.items() for x in pair])
    parts = F.transform(F.split(reply, ","), lambda p: F.try_element_at(
        known, F.lower(F.trim(F.regexp_replace(p, "[^A-Za-z]", "")))))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p.isNotNull())), 1, keep)


def keyword_tags(title: Column, text: Column, names: list[str], keep: int = 5) -> Column:
    """Categories by number of mentions in title and text; ties go by list position."""
    by_lower: dict[str, tuple[int, str]] = {}
    for pos, name in enumerate(names):
        by_lower.setdefault(name.lower(), (pos, name))
    info = F.create_map(*[x for low, (pos, name) in by_lower.items() for x in (
        F.lit(low), F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name")))])

    def ranked(words: Column) -> Column:
        met = F.array_intersect(F.array(*[F.lit(low) for low in by_lower]), words)
        return F.transform(met, lambda m: F.struct(
            (-F.size(F.filter(words, lambda w: w == m))).alias("rank"),
            F.element_at(info, m)["pos"].alias("pos"), F.element_at(info, m)["name"].alias("name")))

    best = F.slice(F.array_sort(_let(tokens(F.concat_ws(" ", title, text)), ranked)), 1, keep)
    return F.when(filled(text), F.transform(best, lambda x: x["name"]))


# Instructions for a text provider, in our own words.
TAG_RULES = ("Choose up to 5 of the listed categories that suit the article best, most suitable first. "
             "Between equals take the one listed earlier. Answer with a JSON array of names only; "
             "answer [] if none suits.")
EXTRACT_RULES = ("Keep only the article itself, word for word, without leftovers of the page around it. "
                 "Answer no to refuse.")
SUMMARY_RULES = ("Shorten the article to its essence in at least 100 characters, in its own words only. "
                 "Answer Done if it has nothing to do with the title: ")


def tag_request(title: Column, text: Column, names: list[str]) -> Column:
    """What is sent with ``TAG_RULES``."""
    return F.concat(F.lit("categories: "), F.to_json(F.array(*[F.lit(n) for n in names])),
                    F.lit("\ntitle: "), F.coalesce(title, F.lit("")),
                    F.lit("\ncontent: "), F.coalesce(text, F.lit("")))


def summary_rules(title: Column) -> Column:
    """Instructions for a summary; they name the title."""
    return F.concat(F.lit(SUMMARY_RULES), F.coalesce(title, F.lit("")))
