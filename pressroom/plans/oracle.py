"""Independent SQL for the checked queries, written for DuckDB on the same tables."""

from __future__ import annotations

import json
import re
from string import ascii_lowercase

from ..functions import text as X
from ..schemas import RETAG_CATEGORIES, category_names

SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WORD = r"[\p{L}\p{N}_]{2,}"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def _code(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 4))::BIGINT / 65536.0)"


def _draw(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_NAMES = category_names()
_LISTED = f"{_list(_NAMES)}"


def _name(n: str, step: int) -> str:
    return f"list_extract({_LISTED}, (({n} * {step}) % {len(_NAMES)} + 1)::BIGINT)"


_RETAG_NAMES = category_names(RETAG_CATEGORIES)
_RETAG = _list(_RETAG_NAMES)


def _letters(text: str) -> str:
    """Counts of the letters a to z in either case."""
    return "[" + ", ".join(f"(2 * length({text}) - length(replace({text}, '{c}', '')) - length(replace({text}, '{c.upper()}', '')))::DOUBLE"
                           for c in ascii_lowercase) + "]"


_REPLY = (f"'[\"' || {_name('doc_id', 1)} || '\", \"' || upper({_name('length(text)', 1)}) || '\", \"' || lang || "
          f"'\", \"5G\", \"' || lower({_name('doc_id', 3)}) || '!\", \"' || {_name('doc_id', 1)} || '\", \"' || "
          f"{_name('length(text)', 5)} || '\", \"' || {_name('length(text)', 7)} || '\", \"' || "
          f"{_name('length(text)', 11)} || '\"]'")



def _grams(source: str, keys: str, row: str, text: str, longest: int) -> str:
    """All 1..longest-grams of ``text`` as rows (keys, n, term), from token positions."""
    runs = [" || ' ' || ".join(["w"] + [f"w{k}" for k in range(1, n)]) for n in range(1, longest + 1)]
    leads = "".join(f", lead(w, {k}) OVER o AS w{k}" for k in range(1, longest))
    return f"""SELECT * FROM (SELECT {keys}, unnest(range(1, {longest + 1})) AS n, unnest([{', '.join(runs)}]) AS term
        FROM (SELECT *{leads} FROM (SELECT {keys}, unnest(t) AS w, unnest(range(0, len(t))) AS p
                                    FROM (SELECT *, {_words(text)} AS t FROM {source}))
              WINDOW o AS (PARTITION BY {row} ORDER BY p))) WHERE term IS NOT NULL"""


_SIZES = "SELECT userid, sum(copies)::BIGINT AS n FROM prepared GROUP BY userid"

# Named building blocks; each may use those above it.
CTES: dict[str, str] = {
    "base": """
        SELECT d.doc_id, 'https://ex.test/a/' || md5(d.text) AS link, 'feed-' || d.source AS feedurl,
               split_part(d.text, chr(10), 1) AS title, d.text AS content,
               CASE WHEN length(d.text) >= 100 THEN d.text END AS textcontent, d.lang, d.source, l.toxic,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (d.doc_id % 30) AS createdat
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "sentence_lists": rf"""
        SELECT doc_id, {_words('title')} AS title_words,
               list_filter(list_transform(regexp_extract_all(textcontent, '[^.!?\n]+[.!?]*'),
                   lambda s: trim(regexp_replace(s, '{SPACE}+', ' ', 'g'))), lambda s: s <> '') AS ss
        FROM base WHERE textcontent IS NOT NULL""",
    "sentences": f"""
        SELECT doc_id, i, ss[i] AS s, len(list_intersect({_words('ss[i]')}, title_words)) AS hits
        FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sentence_lists)""",
    "ranked_sentences": """
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS r FROM sentences WHERE hits > 0""",
    "raw_summaries": """
        SELECT b.doc_id, CASE WHEN b.textcontent IS NOT NULL THEN coalesce(s.joined, 'Done') END AS raw_summary
        FROM base b LEFT JOIN (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS joined FROM ranked_sentences
                               WHERE r <= 3 GROUP BY doc_id) s ON s.doc_id = b.doc_id""",
    "backend": """
        SELECT b.doc_id, link, feedurl, title, content, textcontent,
               CASE WHEN trim(raw_summary) <> '' AND length(raw_summary) >= 50 THEN raw_summary END AS summary,
               CASE WHEN toxic = 1 THEN [lang, source, 'toxic'] WHEN toxic = 0 THEN [lang, source] END AS tags,
               createdat, createdat + INTERVAL 1 DAY AS updatedat, createdat AS pubdate, lang, toxic
        FROM base b JOIN raw_summaries r ON r.doc_id = b.doc_id""",
    "reader": """
        SELECT e.event_id, b.doc_id, b.link AS href, b.feedurl, e.user_id::VARCHAR AS userid, b.title, b.content, b.summary,
               e.ts AS createdat, e.ts AS updatedat,
               CASE e.event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS isliked,
               CASE WHEN e.value >= 2 THEN e.event_type = 'signup' END AS issaved,
               e.event_type IN ('view', 'click') AS isread,
               CASE WHEN e.event_type = 'view' AND e.value < 10 THEN 'markAllAsRead'
                    WHEN e.event_type = 'click' THEN 'read' END AS action,
               e.value, b.toxic
        FROM events e JOIN backend b ON b.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "changes": """
        SELECT event_id, createdat, userid,
               CASE WHEN issaved IS NULL AND isliked IS NULL AND NOT isread THEN 'feeds' ELSE 'articles' END AS collection,
               CASE WHEN value < 5 THEN 'insert' ELSE 'update' END AS operation_type,
               title, summary, toxic, isliked, issaved, isread, action, value
        FROM reader""",
    "training": """
        SELECT DISTINCT u.title, u.userid, u.issaved, u.isliked, u.action, b.summary
        FROM reader u JOIN backend b ON u.href = b.link
        WHERE u.isliked IS NOT NULL OR u.action <> 'markAllAsRead' OR u.action IS NULL""",
    "keyed": """
        SELECT userid, title, coalesce(summary, '') AS summary, issaved, isliked,
               md5(concat_ws(':', coalesce(issaved::VARCHAR, 'null'), coalesce(isliked::VARCHAR, 'null'),
                             md5(coalesce('=' || action, 'null')), md5(coalesce('=' || title, 'null')),
                             md5(coalesce('=' || summary, 'null')), userid)) AS row_key
        FROM training""",
    "labelled": """
        SELECT *, CASE WHEN issaved IS DISTINCT FROM false THEN 1 WHEN isliked IS NULL THEN 0
                       WHEN isliked THEN 1 ELSE -1 END AS y FROM keyed""",
    "stats": """
        SELECT userid, count(*) FILTER (isliked IS NOT NULL) AS labeled_count,
               count(*) FILTER (isliked IS NULL) AS neutral_count, count(*) FILTER (y = 1) AS n_like,
               count(*) FILTER (y = 0) AS n_neutral, count(*) FILTER (y = -1) AS n_dislike
        FROM labelled GROUP BY userid""",
    "balanced": """
        SELECT * EXCLUDE (r, labeled_count, neutral_count) FROM (
            SELECT l.*, s.labeled_count, s.neutral_count,
                   row_number() OVER (PARTITION BY l.userid, l.isliked IS NULL ORDER BY md5('42:' || row_key)) AS r
            FROM labelled l JOIN stats s ON s.userid = l.userid)
        WHERE isliked IS NOT NULL OR labeled_count = 0 OR r <= labeled_count""",
    "forced": """
        SELECT * EXCLUDE (y, r, likes, dislikes),
               CASE WHEN r = 1 AND dislikes = 0 AND likes > 0 THEN -1 WHEN r = 1 AND likes = 0 AND dislikes > 0 THEN 1
                    ELSE y END AS y
        FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY isliked IS NULL, md5('42:' || row_key)) AS r,
                     count(*) FILTER (y = 1) OVER (PARTITION BY userid) AS likes,
                     count(*) FILTER (y = -1) OVER (PARTITION BY userid) AS dislikes FROM balanced)""",
    "prepared": """
        SELECT * EXCLUDE (r, n, most), 1 + (most - n) // n + CASE WHEN r <= (most - n) % n THEN 1 ELSE 0 END AS copies
        FROM (SELECT *, max(n) OVER (PARTITION BY userid) AS most FROM (
            SELECT *, count(*) OVER (PARTITION BY userid, y) AS n,
                   row_number() OVER (PARTITION BY userid, y ORDER BY md5('42:' || row_key)) AS r FROM forced))""",
    "gram_rows": """
        SELECT userid, row_key, copies, 'title' AS block, title AS text FROM prepared
        UNION ALL SELECT userid, row_key, copies, 'summary', summary FROM prepared""",
    "gram_counts": f"""
        SELECT userid, row_key, copies, block, term, count(*) AS tf
        FROM ({_grams('gram_rows', 'userid, row_key, copies, block', 'row_key, block', 'text', 5)}) GROUP BY userid, row_key, copies, block, term""",
    "vocab": f"""
        SELECT userid, block, term, df, tf, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
            SELECT *, row_number() OVER (PARTITION BY userid, block ORDER BY tf DESC, md5(term), term) AS r FROM (
                SELECT g.*, s.n FROM (
                    SELECT userid, block, term, sum(copies)::BIGINT AS df, sum(tf * copies)::BIGINT AS tf
                    FROM gram_counts GROUP BY userid, block, term) g JOIN ({_SIZES}) s ON s.userid = g.userid)
            WHERE df <= 0.7::DOUBLE * n)
        WHERE r <= CASE block WHEN 'title' THEN 10000 ELSE 1000000 END""",
    "weights": """
        SELECT row_key, block, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_key, block)) AS weight
        FROM (SELECT g.row_key, g.block, g.term, g.tf * v.idf AS raw FROM gram_counts g
              JOIN vocab v ON v.userid = g.userid AND v.block = g.block AND v.term = g.term)""",
    "updates": """
        SELECT doc_id, feedurl, link, 'revised: ' || textcontent AS textcontent, 'new: ' || summary AS summary,
               list_append(tags, 'fresh') AS tags, updatedat + INTERVAL 40 DAY AS updatedat
        FROM (SELECT *, row_number() OVER (PARTITION BY feedurl, link ORDER BY updatedat DESC, doc_id DESC) AS r
              FROM backend WHERE coalesce(textcontent, '') <> '' AND coalesce(summary, '') <> '' AND tags IS NOT NULL)
        WHERE r = 1""",
    "reader_side": """
        SELECT event_id, href, feedurl, CASE WHEN NOT isread THEN summary END AS summary, [action] AS tags, updatedat
        FROM reader""",
    "categories": "SELECT unnest(range(0, {n})) AS pos, unnest({names}) AS name".format(n=len(_NAMES), names=_LISTED),
    "tag_rows": """
        SELECT feedurl, doc_id, slot, tags[slot + 1] AS tag FROM (
            SELECT feedurl, doc_id, tags, unnest(range(0, len(tags))) AS slot FROM backend)""",
    "tag_terms": f"""
        SELECT feedurl, doc_id, slot, term, count(*) AS tf
        FROM ({_grams('tag_rows', 'feedurl, doc_id, slot', 'doc_id, slot', 'tag', 3)}) GROUP BY feedurl, doc_id, slot, term""",
    "tag_vocab": """
        SELECT t.feedurl, slot, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tag_terms t
        JOIN (SELECT feedurl, count(*) AS n FROM backend GROUP BY feedurl) s ON s.feedurl = t.feedurl
        GROUP BY t.feedurl, slot, term, n""",
    "usable_pages": """
        SELECT * FROM (SELECT page_id, url, html, CASE WHEN contains(url, '#') THEN 'application/pdf'
                              WHEN contains(url, '?') THEN 'TEXT/HTML' ELSE 'text/html; charset=utf-8' END AS content_type
                       FROM pages)
        WHERE (content_type LIKE '%text%' OR content_type LIKE '%html%') AND length(html) > 0""",
}

_TAGS = "array_to_string({}, ',')".format

QUERIES: dict[str, str] = {
    "training_rows": "SELECT * FROM training",
    "preference_labels": "SELECT row_key, userid, y FROM labelled",
    "training_stats": "SELECT * FROM stats",
    "label_split": """SELECT row_key, userid, isliked, CASE WHEN isliked IS NULL THEN 'neutral' ELSE 'labelled' END AS side
                      FROM keyed""",
    "balance_neutral": "SELECT userid, row_key, isliked, issaved FROM balanced",
    "holdout_split": """
        SELECT userid, row_key, row_number() OVER (PARTITION BY userid ORDER BY md5('42:' || row_key))
               <= round_even(count(*) OVER (PARTITION BY userid) * 0.2, 0) AS held_out FROM keyed""",
    "force_missing_class": """
        SELECT who AS userid, row_key,
               CASE WHEN r = 1 AND dislikes = 0 AND likes > 0 THEN -1 WHEN r = 1 AND likes = 0 AND dislikes > 0 THEN 1
                    ELSE y END AS y
        FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY isliked IS NULL, md5('42:' || row_key)) AS r,
                     count(*) FILTER (y = 1) OVER (PARTITION BY who) AS likes,
                     count(*) FILTER (y = -1) OVER (PARTITION BY who) AS dislikes
              FROM (SELECT *, userid || ' ' || split_part(title, ' ', 1) AS who FROM labelled))""",
    "oversample": """
        SELECT userid, row_key, y, 1 + (most - n) // n + CASE WHEN r <= (most - n) % n THEN 1 ELSE 0 END AS copies
        FROM (SELECT *, max(n) OVER (PARTITION BY userid) AS most FROM (
            SELECT *, count(*) OVER (PARTITION BY userid, y) AS n,
                   row_number() OVER (PARTITION BY userid, y ORDER BY md5('42:' || row_key)) AS r FROM labelled))""",
    "neutral_skip": f"""
        SELECT event_id, y, round(p, 6) AS p, y = 0 AND {_draw('event_id::VARCHAR', 42)} < p AS skip FROM (
            SELECT event_id, CASE WHEN issaved IS DISTINCT FROM false THEN 1 WHEN isliked IS NULL THEN 0
                                  WHEN isliked THEN 1 ELSE -1 END AS y,
                   CASE WHEN n > l THEN 1 - l::DOUBLE / n ELSE 0.0 END AS p
            FROM reader JOIN (SELECT userid, count(*) FILTER (issaved) AS l, count(*) FILTER (isliked IS NULL) AS n
                              FROM reader GROUP BY userid) c USING (userid))""",
    "tfidf_vocab": f"""
        SELECT userid, block, df, tf, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term,
               round(max(idf), 6) AS idf, round(sum({_code('term')}), 6) AS code
        FROM vocab GROUP BY userid, block, df, tf""",
    "tfidf_transform": f"""
        SELECT row_key, block, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS greatest,
               round(sum(weight * weight), 6) AS squares, round(sum(weight * {_code('term')}), 6) AS code
        FROM weights GROUP BY row_key, block""",
    "ordered_tag_features": f"""
        SELECT b.feedurl, b.doc_id, s.slot::INTEGER AS slot, coalesce(v.width, 1) AS width,
               coalesce(w.n_terms, 0) AS n_terms, coalesce(w.total, 0.0) AS total
        FROM backend b
        JOIN (SELECT feedurl, unnest(CASE WHEN max(coalesce(len(tags), 0)) > 0 THEN range(0, max(len(tags))) ELSE [-1] END)
                     AS slot FROM backend GROUP BY feedurl) s ON s.feedurl = b.feedurl
        LEFT JOIN (SELECT feedurl, slot, count(*) AS width FROM tag_vocab GROUP BY feedurl, slot) v
               ON v.feedurl = s.feedurl AND v.slot = s.slot
        LEFT JOIN (SELECT feedurl, doc_id, slot, count(*) AS n_terms, round(sum(raw / norm), 6) AS total FROM (
                       SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, slot)) AS norm FROM (
                           SELECT t.feedurl, t.doc_id, t.slot, (1 + ln(tf)) * idf AS raw FROM tag_terms t
                           JOIN tag_vocab v ON v.feedurl = t.feedurl AND v.slot = t.slot AND v.term = t.term))
                   GROUP BY feedurl, doc_id, slot) w
               ON w.feedurl = b.feedurl AND w.doc_id = b.doc_id AND w.slot = s.slot""",
    "score_articles": f"""
        WITH texts AS (SELECT event_id, userid, 'title' AS block, title AS text FROM reader
                       UNION ALL SELECT event_id, userid, 'summary', coalesce(summary, '') FROM reader),
        counts AS (SELECT event_id, userid, block, term, count(*) AS tf
                   FROM ({_grams('texts', 'event_id, userid, block', 'event_id, block', 'text', 5)})
                   GROUP BY event_id, userid, block, term),
        coefs AS (SELECT userid, block, term, idf, ({_code("'dislike:' || term")} - 0.5) * 4 AS d,
                         ({_code("'neutral:' || term")} - 0.5) * 4 AS n, ({_code("'like:' || term")} - 0.5) * 4 AS l
                  FROM vocab),
        parts AS (SELECT event_id, block, sum(w * d) / sqrt(sum(w * w)) AS d, sum(w * n) / sqrt(sum(w * w)) AS n,
                         sum(w * l) / sqrt(sum(w * w)) AS l
                  FROM (SELECT c.event_id, c.block, c.tf * f.idf AS w, d, n, l FROM counts c
                        JOIN coefs f ON f.userid = c.userid AND f.block = c.block AND f.term = c.term)
                  GROUP BY event_id, block),
        z AS (SELECT u.event_id, m.n_neutral > 12 AS ok, m.n_dislike > 9 AS three,
                     1 / (1 + exp(-(0.1 + coalesce(p.d, 0)))) AS d, 1 / (1 + exp(-(0.2 + coalesce(p.n, 0)))) AS n,
                     1 / (1 + exp(-(-0.1 + coalesce(p.l, 0)))) AS l
              FROM reader u LEFT JOIN stats m ON m.userid = u.userid
              LEFT JOIN (SELECT event_id, sum(d) AS d, sum(n) AS n, sum(l) AS l FROM parts GROUP BY event_id) p
                     ON p.event_id = u.event_id)
        SELECT event_id, CASE WHEN ok THEN 'scored' ELSE 'no_model' END AS status,
               CASE WHEN ok THEN round(CASE WHEN three THEN n / (d + n + l) ELSE 1 - l END, 6) END AS neutral,
               CASE WHEN ok THEN round(CASE WHEN three THEN l / (d + n + l) ELSE l END, 6) END AS "like",
               CASE WHEN ok AND three THEN round(d / (d + n + l), 6) END AS dislike,
               CASE WHEN ok AND three THEN round(l / (d + n + l) - d / (d + n + l), 6) END AS preferencescore
        FROM z""",
    "score_struct": """
        SELECT user_id, day, round(neutral, 6) AS neutral, round("like", 6) AS "like", round(dislike, 6) AS dislike,
               round("like" - dislike, 6) AS preferencescore
        FROM (SELECT user_id, ts::DATE::VARCHAR AS day,
                     nullif(count(*) FILTER (event_type NOT IN ('purchase', 'error')), 0) / count(*)::DOUBLE AS neutral,
                     nullif(count(*) FILTER (event_type = 'purchase'), 0) / count(*)::DOUBLE AS "like",
                     nullif(count(*) FILTER (event_type = 'error'), 0) / count(*)::DOUBLE AS dislike
              FROM events GROUP BY ALL)""",
    "no_model_users": """
        SELECT event_id, userid FROM reader WHERE userid NOT IN (SELECT userid FROM stats WHERE n_dislike > 12)""",
    "identified_counts": f"""
        SELECT userid, sum(good)::BIGINT AS liked, sum(CASE WHEN l - d > 0.2 THEN good ELSE 0 END)::BIGINT AS liked_identified,
               sum(bad)::BIGINT AS disliked, sum(CASE WHEN d - l > 0.2 THEN bad ELSE 0 END)::BIGINT AS disliked_identified
        FROM (SELECT userid, coalesce(isliked::INT, 0) + coalesce(issaved::INT, 0) AS good,
                     CASE WHEN NOT isliked THEN 1 ELSE 0 END AS bad, {_draw('row_key', 1)} AS l, {_draw('row_key', 2)} AS d
              FROM keyed) GROUP BY userid""",
    "topk_categories": """
        WITH cats AS (SELECT label, embedding FROM embeddings
                      WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
        near AS (SELECT e.vec_id, c.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY
                     round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.label) AS r
                 FROM embeddings e CROSS JOIN cats c)
        SELECT vec_id, string_agg('cat-' || label, ',' ORDER BY r) AS tags FROM near WHERE r <= 5 GROUP BY vec_id""",
    "retag_articles": f"""
        WITH cats AS (SELECT name, pos, {_letters('name')} AS v FROM (SELECT unnest({_RETAG}) AS name, unnest(range(0, {len(_RETAG_NAMES)})) AS pos)),
        arts AS (SELECT doc_id, link, {_letters('textcontent')} AS v FROM backend WHERE textcontent IS NOT NULL AND trim(textcontent) <> ''),
        near AS (SELECT doc_id, link, name, row_number() OVER (PARTITION BY doc_id ORDER BY
                     round(list_cosine_similarity(a.v, c.v), 6) DESC, pos) AS r FROM arts a CROSS JOIN cats c WHERE list_sum(a.v) > 0),
        tagged AS (SELECT doc_id, link, string_agg(name, ',' ORDER BY r) AS tags FROM near WHERE r <= 5 GROUP BY doc_id, link),
        by_link AS (SELECT link, max_by(tags, doc_id) AS tags FROM tagged GROUP BY link)
        SELECT 'backend' AS side, b.doc_id AS id, CASE WHEN t.doc_id IS NULL THEN {_TAGS('b.tags')} ELSE t.tags END AS tags
        FROM backend b LEFT JOIN tagged t ON t.doc_id = b.doc_id
        UNION ALL SELECT 'reader', event_id, coalesce(l.tags, 'old') FROM reader u LEFT JOIN by_link l ON l.link = u.href""",
    "validate_articles": """
        SELECT doc_id, problems, CASE WHEN problems = '' THEN link END AS link, CASE WHEN problems = '' THEN title END AS title,
               CASE WHEN problems = '' THEN createdat END AS pubdate
        FROM (SELECT *, CASE WHEN textcontent IS NULL THEN 'body' ELSE concat_ws(',',
                  CASE WHEN title = '' THEN 'title' END, CASE WHEN toxic = 1 THEN 'createdAt' END,
                  CASE WHEN lang = 'es' THEN 'pubDate' END) END AS problems FROM base)""",
    "scan_backend_articles": f"""
        SELECT link, content, textcontent, createdat, updatedat, pubdate, {_TAGS('tags')} AS tags, summary, feedurl, title
        FROM backend""",
    "scan_user_articles": """
        SELECT href, feedurl, userid, md5(content) AS content, createdat, updatedat, createdat AS "date", isliked, isread,
               issaved, title, action FROM reader""",
    "event_log_keys": """
        SELECT event_id, collection, userid AS user_id, operation_type,
               concat_ws('/', collection, userid, operation_type, strftime(createdat, '%Y/%m/%d'),
                   epoch_us(createdat) // 1000 || '-' || (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000000)
                   || '.json') AS event_key FROM changes""",
    "article_archive": """
        SELECT * EXCLUDE (r) FROM (
            SELECT *, row_number() OVER (PARTITION BY year, month, day, archive_key ORDER BY updatedat DESC, feedurl DESC,
                                         doc_id DESC) AS r
            FROM (SELECT strftime(createdat, '%Y') AS year, strftime(createdat, '%m') AS month,
                         strftime(createdat, '%d') AS day, concat('backend-articles/', strftime(createdat, '%Y/%m/%d'), '/',
                         regexp_replace(link, '[^a-zA-Z0-9]', '-', 'g'), '/backend-article.json') AS archive_key,
                         updatedat, doc_id, feedurl, title, md5(content) AS content_md5 FROM backend)) WHERE r = 1""",
    "backend_to_user": f"""
        SELECT feedurl, title, summary, link AS href, false AS isread, false AS issaved, NULL::BOOLEAN AS isliked, createdat,
               updatedat, pubdate AS "date", content, {_TAGS('tags')} AS tags FROM backend""",
    "route_events": """
        SELECT event_id, collection, operation_type,
               CASE WHEN collection = 'feeds' OR operation_type <> 'update' THEN 'log_only'
                    WHEN title = '' OR summary IS NULL OR toxic IS NULL THEN 'skip_incomplete'
                    WHEN coalesce(issaved, false) OR isliked IS NOT NULL
                         OR (isread AND action IS DISTINCT FROM 'markAllAsRead') THEN 'train'
                    WHEN value > 30 THEN 'skip_scored' ELSE 'score' END AS route FROM changes""",
    "unscored_articles": "SELECT event_id, userid, href FROM reader WHERE NOT value > 30",
    "fetchable_pages": "SELECT page_id, url, content_type FROM usable_pages",
    "clean_pages": rf"""
        SELECT page_id, CASE WHEN length(text) >= 100 THEN text END AS text FROM (
            SELECT page_id, regexp_replace(chr(8594) || chr(172) || 'it;' || chr(8755) || chr(169) || 'x ' || chr(8212) || ' ' || chr(8211) || ' ' ||
                regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
                regexp_replace(regexp_replace(regexp_replace(html,
                '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gsi'), '<head>.*?</head>', '', 'gsi'),
                '<nav[^>]*>.*?</nav>', '', 'gsi'), '<[^>]*>', '', 'gs'),
                '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"'), '&amp;', '&'),
                'https?://[^\t\n\f\r ]+', '', 'g'), '{SPACE}+', ' ', 'g') AS text
            FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
    "strip_urls": r"""
        SELECT doc_id, regexp_replace(replace(text, chr(10), ' http://ex.test/line' || chr(10)) || ' https://ex.test/'
               || doc_id || ' end', 'https?://[^\t\n\x0B\f\r ]+', '', 'g') AS text FROM documents""",
    "summary_guard": """
        SELECT r.doc_id, length(raw_summary) AS raw_length, b.summary FROM raw_summaries r JOIN backend b ON b.doc_id = r.doc_id""",
    "extractive_summary": "SELECT doc_id, raw_summary AS summary FROM raw_summaries",
    "parse_tags": f"""
        WITH parts AS (SELECT doc_id, p, unnest(p) AS part, unnest(range(0, len(p))) AS i
                       FROM (SELECT doc_id, string_split({_REPLY}, ',') AS p FROM documents)),
        met AS (SELECT doc_id, name, min(i) AS i FROM parts JOIN categories
                ON lower(name) = lower(regexp_replace(part, '[^A-Za-z]', '', 'g')) GROUP BY doc_id, name),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM met)
        SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY r) FILTER (r <= 5), '') AS tags
        FROM documents d LEFT JOIN ranked k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
    "keyword_tags": f"""
        WITH words AS (SELECT doc_id, unnest({_words(f"split_part(text, chr(10), 1) || ' ' || text || ' ' || {_REPLY}")}) AS w
                       FROM documents),
        met AS (SELECT doc_id, name, pos, count(*) AS n FROM words JOIN categories ON lower(name) = w GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM met)
        SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY r) FILTER (r <= 5), '') AS tags
        FROM documents d LEFT JOIN ranked k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
    "render_prompts": f"""
        SELECT doc_id, 'categories: {json.dumps(_NAMES, separators=(",", ":"))}' || chr(10) || 'title: ' || title || chr(10)
               || 'content: ' || coalesce(textcontent, '') AS tag_request, '{X.SUMMARY_RULES}' || title AS summary_rules
        FROM base""",
    "ngrams": f"""
        SELECT doc_id, n::INTEGER AS n, sum(tf)::BIGINT AS grams, count(*) AS distinct_grams,
               round(sum(tf * {_code('term')}), 6) AS code
        FROM (SELECT doc_id, n, term, count(*) AS tf FROM ({_grams('documents', 'doc_id', 'doc_id', 'text', 5)})
              GROUP BY doc_id, n, term)
        GROUP BY doc_id, n""",
    "reuse_processed": f"""
        WITH known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY updatedat DESC, feedurl DESC) AS r
                       FROM backend WHERE textcontent IS NOT NULL AND summary IS NOT NULL AND tags IS NOT NULL) WHERE r = 1)
        SELECT b.doc_id, b.link, k.link IS NOT NULL AS reused, coalesce(k.summary, b.summary) AS summary,
               {_TAGS('coalesce(k.tags, b.tags)')} AS tags, md5(coalesce(k.textcontent, b.textcontent)) AS text_md5
        FROM backend b LEFT JOIN known k ON k.link = b.link""",
    "commit_ready": """
        SELECT doc_id, feedurl, link FROM backend
        WHERE coalesce(textcontent, '') <> '' AND coalesce(summary, '') <> '' AND tags IS NOT NULL""",
    "merge_backend": f"""
        SELECT b.doc_id, b.link, md5(CASE WHEN u.link IS NULL THEN b.textcontent ELSE u.textcontent END) AS text_md5,
               CASE WHEN u.link IS NULL THEN b.summary ELSE u.summary END AS summary,
               {_TAGS('CASE WHEN u.link IS NULL THEN b.tags ELSE u.tags END')} AS tags,
               CASE WHEN u.link IS NULL THEN b.updatedat ELSE u.updatedat END AS updatedat
        FROM (SELECT *, row_number() OVER (PARTITION BY feedurl, link ORDER BY doc_id) AS r FROM backend) b
        LEFT JOIN updates u ON u.feedurl = b.feedurl AND u.link = b.link AND b.r = 1""",
    "merge_user": f"""
        SELECT event_id, href, CASE WHEN u.link IS NULL THEN b.summary ELSE u.summary END AS summary,
               coalesce({_TAGS('CASE WHEN u.link IS NULL THEN b.tags ELSE u.tags END')}, '') AS tags,
               CASE WHEN u.link IS NULL THEN b.updatedat ELSE u.updatedat END AS updatedat
        FROM reader_side b LEFT JOIN updates u ON u.feedurl = b.feedurl AND u.link = b.href""",
    "late_enrichment": f"""
        SELECT event_id, href, coalesce(u.summary, b.summary) AS summary,
               coalesce({_TAGS('coalesce(u.tags, b.tags)')}, '') AS tags, coalesce(u.updatedat, b.updatedat) AS updatedat
        FROM reader_side b LEFT JOIN updates u
          ON u.feedurl = b.feedurl AND u.link = b.href AND coalesce(b.summary, '') = ''""",
    "retag_merge": f"""
        SELECT 'backend' AS side, b.doc_id AS id, {_TAGS('CASE WHEN u.doc_id IS NULL THEN b.tags ELSE u.tags END')} AS tags
        FROM backend b LEFT JOIN updates u ON u.doc_id = b.doc_id
        UNION ALL
        SELECT 'reader', event_id, coalesce({_TAGS('CASE WHEN u.link IS NULL THEN b.tags ELSE u.tags END')}, '')
        FROM reader_side b LEFT JOIN (SELECT link, tags, row_number() OVER (PARTITION BY link ORDER BY updatedat DESC,
                                             doc_id DESC) AS r FROM updates) u ON u.link = b.href AND u.r = 1""",
    "score_merge": """
        SELECT event_id, round(CASE WHEN isliked THEN (1 - s) / 2 WHEN value > 30 THEN 0.5 END, 6) AS neutral,
               round(CASE WHEN isliked THEN s WHEN value > 30 THEN 0.3 END, 6) AS "like",
               round(CASE WHEN isliked THEN (1 - s) / 2 WHEN value > 30 THEN 0.2 END, 6) AS dislike,
               round(CASE WHEN isliked THEN s - (1 - s) / 2 WHEN value > 30 THEN 0.1 END, 6) AS preferencescore
        FROM (SELECT *, value / (value + 1) AS s FROM reader)""",
}

QUERIES["keyed_updates"] = f"""
        SELECT m.*, s.neutral, s."like", s.dislike, s.preferencescore
        FROM ({QUERIES['merge_user']}) m JOIN ({QUERIES['score_merge']}) s ON s.event_id = m.event_id"""


def _step(side: str, of: str, b: float) -> str:
    """A reader's step on one side: rate times sign over 1 + exp(margin)."""
    t = f"CASE WHEN y = {of} THEN 1 ELSE -1 END"
    return f"0.5 * ({t}) / (1 + exp(({t}) * (coalesce({side}, 0) + {b})))"


def _moved(side: str) -> str:
    """A coefficient after one step: all shrink, those of the row's terms move and are pulled towards zero."""
    value = f"(f.{side} * (1 - 0.85 * 0.5 * 0.01) + s.{side} * x.x)"
    return (f"CASE WHEN NOT s.applied THEN f.{side} WHEN s.{side} IS NULL THEN 0 WHEN x.x IS NULL THEN f.{side} * (1 - 0.85 * 0.5 * 0.01) "
            f"ELSE sign({value}) * greatest(abs({value}) - 0.15 * 0.5 * 0.01, 0) END")


QUERIES["update_models"] = f"""
        WITH firsts AS (SELECT userid, event_id, title, coalesce(summary, '') AS summary,
                               CASE WHEN issaved IS DISTINCT FROM false THEN 1 WHEN isliked IS NULL THEN 0 WHEN isliked THEN 1 ELSE -1 END AS y
                        FROM reader QUALIFY row_number() OVER (PARTITION BY userid ORDER BY event_id) = 1),
        texts AS (SELECT userid, 'title' AS block, title AS text FROM firsts UNION ALL SELECT userid, 'summary', summary FROM firsts),
        counts AS (SELECT userid, block, term, count(*) AS tf FROM ({_grams('texts', 'userid, block', 'userid, block', 'text', 5)})
                   GROUP BY userid, block, term),
        coefs AS (SELECT userid, block, term, idf, ({_code("'dislike:' || term")} - 0.5) * 4 AS d,
                         ({_code("'neutral:' || term")} - 0.5) * 4 AS n, ({_code("'like:' || term")} - 0.5) * 4 AS l FROM vocab),
        xs AS (SELECT userid, block, term, d, n, l, w / sqrt(sum(w * w) OVER (PARTITION BY userid, block)) AS x
               FROM (SELECT c.*, c.tf * f.idf AS w, d, n, l FROM counts c JOIN coefs f USING (userid, block, term))),
        sums AS (SELECT userid, sum(x * d) AS d, sum(x * n) AS n, sum(x * l) AS l FROM xs GROUP BY userid),
        models AS (SELECT m.userid, m.labeled_count, m.neutral_count, m.n_neutral > 12 AS ok, m.n_dislike > 9 AS three, y, d, n, l,
                          m.n_neutral > 12 AND NOT (y = 0 AND m.neutral_count > m.labeled_count
                              AND {_draw('event_id::VARCHAR', 42)} < 1 - m.labeled_count / m.neutral_count) AS applied
                   FROM stats m JOIN firsts USING (userid) LEFT JOIN sums USING (userid)),
        steps AS (SELECT userid, ok, applied, labeled_count + (y <> 0)::BIGINT AS labeled_count, neutral_count + (y = 0)::BIGINT AS neutral_count,
                         CASE WHEN applied AND three THEN {_step('d', '-1', 0.1)} END AS d,
                         CASE WHEN applied AND three THEN {_step('n', '0', 0.2)} END AS n,
                         CASE WHEN applied THEN {_step('l', '1', -0.1)} END AS l FROM models),
        moved AS (SELECT f.userid, f.term, {_moved('d')} AS d, {_moved('n')} AS n, {_moved('l')} AS l
                  FROM coefs f JOIN steps s USING (userid) LEFT JOIN xs x USING (userid, block, term)),
        folded AS (SELECT userid, count(*) AS n_terms, sum(d * {_code('term')}) AS d, sum(n * {_code('term')}) AS n,
                          sum(l * {_code('term')}) AS l FROM moved GROUP BY userid)
        SELECT s.userid, CASE WHEN ok THEN 'trained' ELSE 'insufficient_labels' END AS status, labeled_count, neutral_count,
               round(0.1 + 0.01 * coalesce(s.d, 0), 6) AS dislike_b, round(0.2 + 0.01 * coalesce(s.n, 0), 6) AS neutral_b,
               round(-0.1 + 0.01 * coalesce(s.l, 0), 6) AS like_b, coalesce(n_terms, 0) AS n_terms,
               round(t.d, 6) AS dislike, round(t.n, 6) AS neutral, round(t.l, 6) AS "like"
        FROM steps s LEFT JOIN folded t USING (userid)"""


def _needed(text: str, done: dict[str, str]) -> None:
    for name, body in CTES.items():
        if name not in done and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            _needed(body, done)
            done[name] = body


def full(query: str) -> str:
    """The query with the building blocks it uses in front."""
    done: dict[str, str] = {}
    _needed(query, done)
    query = query.strip()
    ctes = [f"{name} AS ({body})" for name, body in done.items()]
    if not ctes:
        return query
    if query.startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + query[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + query


def sql() -> dict[str, str]:
    return {name: full(text) for name, text in QUERIES.items()}
