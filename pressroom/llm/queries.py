"""The operators over their whole tables, with production parameters, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .unitcodes import tokenizer_file


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"), window=35).drop("factors")


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A source is an owner, its texts of one language a repository."""
    from .secret_scan import scan_secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return scan_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    from .pii import find_personal

    return find_personal(spark.read.parquet(f"{sf}/documents.parquet"), sample_docs=2000).drop("found")


def op4_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    from .warc_index import archive_and_read

    return archive_and_read(spark.read.parquet(f"{sf}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return read_tokens(write_tokens(docs, tokenizer_file("word_bpe_49k.json"), end_id=2))


def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    from .wrapper import extract_text

    return extract_text(spark.read.parquet(f"{sf}/pages.parquet"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .fm_index import find_contamination

    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    return find_contamination(docs, benchmark, window=13, share=0.05).drop("spans")


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    from .repetition import quality

    return quality(spark.read.parquet(f"{sf}/documents.parquet"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import pack_documents

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, window=2048)


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from .jaccard_join import join_similar

    return join_similar(spark.read.parquet(f"{sf}/documents.parquet"), size=5, percent=75)


def op11_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), least=0.9, nearest=12, least_shared=2)


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf}/embeddings.parquet"), components=32).drop("eigenvalue")


def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs are folded from texts in lower case wherever three divides the checksum of the id."""
    from .merkle import lowered, manifest

    return manifest(spark.read.parquet(f"{sf}/documents.parquet"), tampered=lowered(3)).drop("lang", "path")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_personal_data, op4_warc_index, op5_token_files, op6_main_text, op7_decontamination, op8_quality, op9_packing,
                                     op10_jaccard_join, op11_near_vectors, op12_whitening, op13_manifest)}


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# one step a byte and eight a bit: a number to be xored, or -1 for a shift
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, 1 + length(doc_id::VARCHAR)),
    lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295::BIGINT)"""

_PLAIN, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_words('text', _PLAIN)} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_words(_lower('text'), _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words(_lower('text'), _ALNUM)} AS w FROM benchmark),
bs AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS p FROM bs),
sizes AS (SELECT DISTINCT n FROM phrases),
ds AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes),
hits AS (SELECT doc_id, i, ds.n, item_id FROM ds JOIN phrases ON ds.n = phrases.n AND ds.w[i:i + ds.n - 1] = p),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_lower('text'), _PLAIN)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY shingle) AS t FROM s),
-- copies of one set of shingles meet others once
sets AS (SELECT doc_id, list(t ORDER BY t) AS ts FROM numbered GROUP BY 1),
heads AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ts) AS head FROM sets),
h AS (SELECT numbered.* FROM numbered JOIN heads USING (doc_id) WHERE doc_id = head),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM h a JOIN h b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, head FROM heads UNION SELECT head, doc_id FROM heads),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)""",
    "op11_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
many AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN many USING (vec_id)""",
    "op13_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('text')} AS leaf,
    {_leaf(f"CASE WHEN {_CRC32} % 3 = 0 THEN {_lower('text')} ELSE text END")} AS found,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM documents),
n(lang, lvl, pos, total, node) AS (SELECT lang, 0, pos, count(*) OVER (PARTITION BY lang), leaf FROM d UNION ALL
  SELECT lang, lvl + 1, pos // 8, (total + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM n WHERE total > 1 GROUP BY lang, lvl, pos // 8, total),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM n WHERE total = 1),
t(lvl, pos, total, node) AS (SELECT 0, pos, count(*) OVER (), subroot FROM subroots UNION ALL
  SELECT lvl + 1, pos // 8, (total + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE total > 1 GROUP BY lvl, pos // 8, total),
steps AS (
  SELECT doc_id, lvl, string_agg(node, '' ORDER BY n.pos) FILTER (n.pos < (d.pos >> 3 * lvl)) AS l,
    string_agg(node, '' ORDER BY n.pos) FILTER (n.pos > (d.pos >> 3 * lvl)) AS r
  FROM d JOIN n ON d.lang IS NOT DISTINCT FROM n.lang AND n.total > 1 AND n.pos // 8 = (d.pos >> 3 * (lvl + 1)) GROUP BY doc_id, lvl
  UNION ALL
  SELECT doc_id, 1000 + lvl, string_agg(node, '' ORDER BY t.pos) FILTER (t.pos < (s.pos >> 3 * lvl)),
    string_agg(node, '' ORDER BY t.pos) FILTER (t.pos > (s.pos >> 3 * lvl))
  FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang JOIN t ON t.total > 1 AND t.pos // 8 = (s.pos >> 3 * (lvl + 1)) GROUP BY doc_id, lvl),
paths AS (SELECT doc_id, list(coalesce(l, '') || ',' || coalesce(r, '') ORDER BY lvl) AS path FROM steps GROUP BY 1),
o AS (SELECT doc_id, leaf, subroot, (SELECT node FROM t WHERE total = 1) AS root, coalesce(path, []) AS path, found
  FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths USING (doc_id)),
f AS (SELECT *, list_reduce(list_prepend(found, path), lambda a, x: sha256(split_part(x, ',', 1) || a || split_part(x, ',', 2))) AS folded_root FROM o)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM f""",
    "op4_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS f FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > f THEN f END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
}
