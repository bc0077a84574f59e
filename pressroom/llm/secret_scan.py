"""Secrets in texts, told apart by how many repositories and owners of the corpus have them.

Candidates are three patterns (assignments to a secret's name, access keys, long hex runs) and, beside them,
long mixed tokens. All are found once, as places and value digests. Digests are counted over distinct
repositories and owners: a value of several owners is a widely copied example, a value of one owner looks live.
The patterns' spans stay whatever the count; a mixed token is a span only if it looks live.

DataFrame functions only. Places come from the lengths of the pieces between matches, so they count code points.
Values are pre-aggregated by owner before they are shuffled, and the counts are joined back by a plain
skew join, so a value in a third of all texts is no single task's load.

Null texts are empty; null repositories and owners are one of their own each; repeated rows are scanned
each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the least length can't pass, and a match always takes its whole run.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
LEAST = {"assign": 12, "access": 18, "hex": 16, "mixed": 20}
_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


def _matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """All matches as (start, kind, end, value); empty where there is none, without a second look at the text."""
    at = F.lit(pattern)
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, at, F.lit(0)).alias("match"),
                        F.regexp_extract_all(text, at, F.lit(group)).alias("value"))
    rows = F.filter(rows, lambda x: x["match"].isNotNull())  # the gap after the last match

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _SPANS).alias("spans"))
    found = F.aggregate(rows, zero, step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), F.filter(found, lambda x: F.length(x["value"]) >= LEAST[KINDS[kind]])).otherwise(
        F.from_json(F.lit("[]"), _SPANS))


def _mixed(text: Column, base: Column) -> Column:
    """Long tokens of letters and digits with ten different characters, apart from the patterns' spans."""
    return F.filter(_matches(text, 3, MIXED), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
                    & (F.size(F.array_distinct(F.split(x["value"], ""))) >= 10)
                    & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    parts = F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def find_candidates(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, repo, owner and all candidates of a text; values are digests."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), text.alias("text"))
    rows = rows.select("doc_id", "repo", "owner", "text", F.concat(
        _matches(F.col("text"), 0, ASSIGN, 2), _matches(F.col("text"), 1, ACCESS), _matches(F.col("text"), 2, HEX)).alias("base"))
    spans = F.concat("base", _mixed(F.col("text"), F.col("base")))
    digest = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("value"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", F.transform(spans, digest).alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value: the distinct repositories and owners that have it."""
    seen = candidates.select(F.explode("spans.value").alias("value"), F.coalesce("owner", F.lit("")).alias("owner"),
                             F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    return (seen.groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value")
            .agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))


def scan_secrets(docs: DataFrame, repo: Column, owner: Column, max_owners: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: counts and hash of the patterns' spans, all spans, and how many look live or copied."""
    found = stage(find_candidates(docs, repo, owner, id_col, text_col))
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    told = each.join(ownership(found), "value").withColumn("live", F.col("owners") <= max_owners)
    spans = (told.where("kind < 3 or live").groupBy("row")
             .agg(F.collect_list(F.struct("start", "kind", "end", "live")).alias("all")))
    rows = found.select("row", "doc_id").join(spans, "row", "left")
    every = F.coalesce("all", F.from_json(F.lit("[]"), "array<struct<start: int, kind: int, end: int, live: boolean>>"))
    rows = rows.select("doc_id", every.alias("all"), F.filter(every, lambda x: x["kind"] < 3).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda x: ~x["live"])).cast("long").alias("n_copied"))
