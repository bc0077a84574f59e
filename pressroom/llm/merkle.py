"""Merkle manifest of a table of documents: leaves, a tree per language, one root, proofs for every row.

Levels are kept as strings: a block is ``BLOCK`` neighbouring nodes of one tree, joined to one string of hex
digits. A node is 64 digits, a run of ``RUN`` nodes a fixed-width substring, so parents are digests of
substrings, and the siblings of a node are the substrings left and right of it in its run. A block of more
than one in its tree gives one node ``DEPTH`` levels up; these nodes are the next round's leaves, until a
tree has one node. The subroots of all trees go through the same steps as the leaves of one last tree.

Rows are numbered by a range shuffle and counts per (partition, tree), so a language of any share of the
rows is spread over all tasks; a block holds 512 rows; the driver sees no node.

A leaf digests doc_id, source, lang, n_chars and text, each as ``-`` for null, else byte count, colon, value.
Null languages are a tree of their own, the first. Rows without id come first in their tree and are never
tampered with; rows of one id lie next to each other in the order of their digests, so repeated rows give
the same root in any order of the input. Empty and very long texts are nothing special; other columns are
not read. An empty table has no rows and no root.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import stage

RUN = 8
DEPTH = 3
BLOCK = RUN ** DEPTH
HEX = 64  # digits of a node
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its tree from 0, and ``n``, the size of the tree."""
    at = stage(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                   .withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    here = at.groupBy("_part", tree).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_many"))
    of_tree = Window.partitionBy(tree)
    here = here.withColumns({"_before": F.sum("_many").over(of_tree.orderBy("_part")) - F.col("_many"),
                             "n": F.sum("_many").over(of_tree)})
    return at.join(here, ["_part", tree]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")) \
        .drop("_at", "_part", "_first", "_many", "_before")


def _parents(level: Column) -> Column:
    """The level above, from a level's string."""
    runs = F.ceil(F.length(level) / (HEX * RUN)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(
        F.substring(level, i * (HEX * RUN) + 1, F.lit(HEX * RUN)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Blocks of nodes (tree, pos, n, node, carried columns..): members in order, a string for each level, and
    the node the block gives to the next round. ``up``: levels from a member to that node."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", *carry)))
    out = nodes.groupBy("tree", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(members.alias("members"))
    out = out.withColumn("level0", F.array_join("members.node", "").cast("binary"))
    for i in range(DEPTH):
        out = out.withColumn(f"level{i + 1}", _parents(F.col(f"level{i}")))
    up = F.lit(DEPTH)
    for i in reversed(range(DEPTH)):
        up = F.when(F.col("n") <= RUN ** i, i).otherwise(up)
    out = out.withColumn("up", up)
    node = F.element_at(F.array(*[F.col(f"level{i}") for i in range(DEPTH + 1)]), F.col("up") + 1)
    return out.withColumn("node", node.cast("string"))


def _climb(nodes: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The staged blocks of each round, and the one node (tree, node) every tree ends in."""
    rounds = [stage(_blocks(nodes, carry))]
    while rounds[-1].where(F.col("n") > BLOCK).head(1):
        above = rounds[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "node")
        rounds.append(stage(_blocks(above, [])))
    return rounds, rounds[-1].select("tree", "node")


def _flanks(level: str, at: Column) -> Column:
    """What stands left and right of a node in its run."""
    whole = F.col(level)
    first = at - at % RUN
    end = F.least(first + RUN, (F.length(whole) / HEX).cast("int"))
    return F.struct(F.substring(whole, first * HEX + 1, (at - first) * HEX).cast("string").alias("left"),
                    F.substring(whole, (at + 1) * HEX + 1, (end - at - 1) * HEX).cast("string").alias("right"))


def _path(i: Column, above: Column) -> Column:
    """Siblings of a block's member ``i`` up to the root, nearest level first."""
    own = F.array(*[_flanks(f"level{k}", F.floor(i / RUN ** k).cast("int")) for k in range(DEPTH)])
    return F.concat(F.slice(own, F.lit(1), F.col("up")), above)


def _each(i_to_struct) -> Column:
    return F.inline(F.transform(F.sequence(F.lit(0), F.size("members") - 1), i_to_struct))


def _paths(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """For each block of the first round, the siblings from its node up: (tree, block, above, carried columns).

    ``ends``: tree, path (from the tree's last node) and columns to carry along.
    """
    extra = [c for c in ends.columns if c not in ("tree", "path")]
    above = ends.select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("above"), *extra)
    for blocks in reversed(rounds[1:]):
        joined = blocks.join(above, ["tree", "block"])
        steps = _each(lambda i: F.struct((F.col("block") * BLOCK + i).alias("at"), _path(i, F.col("above")).alias("path")))
        above = joined.select("tree", *extra, steps).select("tree", F.col("at").alias("block"), F.col("path").alias("above"), *extra)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang, leaf, subroot, root, path (siblings by level, left and right),
    proof_sha256, and the root folded from the ``tampered`` leaf instead, with ``verified``.

    ``tampered``: the text a row is found with later, null where it is found unchanged; by default no row is.
    """
    def leaf(text: Column) -> Column:
        return _digest(*[_field(text if c == "text" else F.col(c)) for c in FIELDS])

    found = F.lit(None).cast("string") if tampered is None else tampered
    rows = docs.select("doc_id", "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"),
                       leaf(F.col("text")).alias("node"), F.when(found.isNotNull(), leaf(found)).alias("found"))
    # written first: the range shuffle reads its input twice, which must not digest the texts twice
    nodes = _numbered(stage(rows), "tree", ["doc_id", "node"])
    rounds, subroots = _climb(nodes, ["doc_id", "lang", "found"])
    names = subroots.select(F.lit(0).alias("top"), F.col("tree").alias("name"), "node")
    numbered = _numbered(names, "top", ["name"]).select(F.col("top").cast("string").alias("tree"), "pos", "n", "node", "name")
    top_rounds, root = _climb(numbered, ["name"])
    ends = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("node").alias("root"))
    top = top_rounds[0].join(_paths(top_rounds, ends), ["tree", "block"])
    of_tree = top.select("root", _each(lambda i: F.struct(
        F.col("members")[i]["name"].alias("tree"), F.col("members")[i]["node"].alias("subroot"), _path(i, F.col("above")).alias("path"))))
    joined = rounds[0].join(_paths(rounds, of_tree), ["tree", "block"])
    each = _each(lambda i: F.struct(F.col("members")[i].alias("row"), _path(i, F.col("above")).alias("path")))
    path = F.col("path")
    siblings = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("row.found", "row.node"), path)
    return joined.select("subroot", "root", each).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.col("row.node").alias("leaf"), "subroot", "root",
        "path", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(every: int = 3) -> Column:
    """A tampering: the text with A-Z in lower case, where ``every`` divides the crc32 of the id."""
    upper = string.ascii_uppercase
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(picked, F.translate("text", upper, upper.lower()))
