"""SQL (DuckDB's) that gives the rows of plans.queries, written apart from it."""

from __future__ import annotations

_W = r"\p{L}\p{N}_"
_TOKEN = rf"[{_W}]+(?:[.,''][{_W}]+)*|[^{_W}\s]+"

_STAR = """
named AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
label AS (SELECT p_name AS label, count(*) FILTER (l_returnflag <> 'N') AS link_occ, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'N') AS link_doc,
                 count(*) AS text_occ, count(DISTINCT l_orderkey) AS text_doc FROM named GROUP BY ALL),
sense0 AS (SELECT p_name AS label, l_partkey, count(*) AS occ, count(DISTINCT l_orderkey) AS doc FROM named WHERE l_returnflag <> 'N' GROUP BY ALL),
sense AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc DESC, l_partkey) - 1 AS sense_rank FROM sense0),
page AS (SELECT p_partkey, p_brand || ' ' || p_name AS title FROM part),
txt AS (SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, p_name) AS text FROM named GROUP BY ALL),
bi AS (SELECT DISTINCT l_orderkey, w[i] || ' ' || w[i + 1] AS label FROM (SELECT l_orderkey, w, unnest(range(1, len(w))) AS i FROM (SELECT l_orderkey, string_split(text, ' ') AS w FROM txt))),
cand AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, l_orderkey, label.*, CAST(sense.l_partkey AS VARCHAR) AS id, sense.l_partkey AS partkey, sense_rank, title,
                link_doc / text_doc AS lp, doc / text_doc AS sp, occ / link_occ AS pp
         FROM bi JOIN label USING (label) JOIN sense ON sense.label = label.label JOIN page ON p_partkey = sense.l_partkey),
best AS (SELECT * FROM cand WHERE sense_rank = 0)"""

_URL = "'http://en.wikipedia.org/wiki/' || replace(replace(title, '#', '%23'), ' ', '%20')"

_FOLLOWS = """
follows AS (SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b)"""

_GRAMS = rf"""
grams AS (SELECT array_to_string(t[i:i + n - 1], ' ') AS ngram, t, n, i FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (
    SELECT t, unnest(range(1, len(t) + 1)) AS n FROM (SELECT regexp_extract_all(title, '{_TOKEN}') AS t FROM page))))"""

#: Greedy longest match, label after label.
_GREEDY = """
ordered AS (SELECT l_orderkey, label, row_number() OVER (PARTITION BY l_orderkey ORDER BY length(label) DESC, pp DESC, label, id) AS k FROM best),
fold AS (SELECT t.l_orderkey, 0::BIGINT AS k, text AS rest, false AS kept, '' AS label FROM txt t
         UNION ALL
         SELECT f.l_orderkey, o.k, CASE WHEN contains(rest, o.label) THEN replace(rest, o.label, '') ELSE rest END, contains(rest, o.label), o.label
         FROM fold f JOIN ordered o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1),
largest AS (SELECT b.* FROM best b JOIN fold f ON f.l_orderkey = b.l_orderkey AND f.label = b.label WHERE kept)"""


def _overlap(edges: str) -> str:
    """Features of neighbours that other labels of the same order link to; edges: page, other."""
    return f"""WITH RECURSIVE {_STAR}, {_FOLLOWS}, e AS ({edges}), d AS (SELECT page, count(*) AS n FROM e GROUP BY ALL)
        SELECT x.request_id, x.label, x.id, CAST(count(*) AS DOUBLE) AS label_overlap, CAST(count(DISTINCT y.label) AS DOUBLE) AS label_unique, CAST(count(*) AS DOUBLE) AS entity_overlap,
               CAST(count(DISTINCT y.id) AS DOUBLE) AS entity_unique, round(count(DISTINCT y.id) / max(d.n), 9) AS entity_proportion, round(sum(y.sp), 9) AS sense_prob_sum,
               round(sum(y.pp), 9) AS prior_prob_sum, round(sum(y.lp), 9) AS cmns_sum
        FROM best x JOIN e ON e.page = x.partkey JOIN best y ON y.request_id = x.request_id AND y.partkey = e.other AND y.label <> x.label JOIN d ON d.page = x.partkey GROUP BY ALL"""


_GRAPH = f"""WITH RECURSIVE {_STAR},
chunks AS (SELECT CAST(o_custkey AS VARCHAR) AS context, l_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS chunk FROM txt JOIN orders ON o_orderkey = l_orderkey),
made AS (SELECT context, '[Chunk' || chunk || ']' AS a, '[Chunk' || (chunk - 1) || ']' AS b, chunk FROM chunks WHERE chunk > 0
         UNION ALL SELECT context, '[' || chunk || '-' || label || ']', title, chunk FROM best JOIN chunks USING (l_orderkey) WHERE sp >= 0.01
         UNION ALL SELECT context, '[' || chunk || '-' || label || ']', '[Chunk' || chunk || ']', chunk FROM best JOIN chunks USING (l_orderkey) WHERE sp >= 0.01),
e0 AS (SELECT context, least(a, b) AS src, greatest(a, b) AS dst, CAST(max(chunk) AS INT) AS t FROM made GROUP BY ALL),
graph AS (SELECT e0.* FROM e0 JOIN (SELECT context, max(chunk) AS last FROM chunks GROUP BY ALL) USING (context) WHERE t >= last - 100),
twice AS (SELECT context, src AS node, dst AS other FROM graph UNION ALL SELECT context, dst, src FROM graph),
deg AS (SELECT context, node, count(*) AS degree FROM twice GROUP BY ALL),
nodes AS (SELECT *, count(*) OVER (PARTITION BY context) AS n FROM deg),
r0 AS (SELECT context, node, n, degree, 1.0::DOUBLE / n AS r FROM nodes)"""


def _round(k: int) -> str:
    return f"r{k} AS (SELECT n.context, n.node, n.n, n.degree, 0.15::DOUBLE / n.n + 0.85::DOUBLE * sum(p.r / p.degree) AS r FROM twice b JOIN r{k - 1} p ON p.context = b.context AND p.node = b.node JOIN nodes n ON n.context = b.context AND n.node = b.other GROUP BY n.context, n.node, n.n, n.degree)"


_VIEWS = """
v AS (SELECT event_type AS title, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY ALL),
w AS (SELECT title, day, {sums} FROM v)""".format(sums=", ".join(f"coalesce(CAST(sum(views) OVER (PARTITION BY title ORDER BY day RANGE BETWEEN INTERVAL {d} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS BIGINT), 0) AS views_{k}" for k, d in (("day", 1), ("week", 7), ("4week", 28), ("year", 365))))

_HISTORY = """
hist AS (SELECT lang AS request_id, source AS context, CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS num,
                round(length(regexp_replace(text, '[^e]', '', 'g')) / greatest(length(text), 1), 3) AS score,
                CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS feedback FROM documents d LEFT JOIN labels USING (doc_id))"""

_METRICS = """
rows_ AS (SELECT context AS k, CAST(feedback = 'positive' AS INT) AS y, score FROM hist WHERE feedback IS NOT NULL
          UNION ALL SELECT '*', CAST(feedback = 'positive' AS INT), score FROM hist WHERE feedback IS NOT NULL),
base AS (SELECT k, count(*) AS n, sum(y) AS p, count(*) - sum(y) AS q, count(*) FILTER (y = 1 AND score > 0.1) AS tp, count(*) FILTER (y = 0 AND score > 0.1) AS fp FROM rows_ GROUP BY ALL),
lev AS (SELECT k, score, count(*) AS c, sum(y) AS pos FROM rows_ GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER w AS seen, sum(pos) OVER w AS hits FROM lev WINDOW w AS (PARTITION BY k ORDER BY score DESC)),
rank_ AS (SELECT cum.k, sum(pos * hits / seen) / nullif(any_value(p), 0) AS ap, sum(pos * greatest(0, least(c, p - (seen - c))) / c) / nullif(any_value(p), 0) AS rp FROM cum JOIN base USING (k) GROUP BY ALL),
auc_ AS (SELECT a.k, sum(a.pos * (b.c - b.pos) * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / nullif(max(p * q), 0) AS auc
         FROM lev a JOIN lev b USING (k) JOIN base USING (k) GROUP BY ALL),
m AS (SELECT k, (tp + q - fp) / n AS accuracy, 1 - (tp + q - fp) / n AS zero_one_loss,
             (p * coalesce(tp / nullif(tp + fp, 0), 0) + q * coalesce((q - fp) / nullif(q - fp + p - tp, 0), 0)) / n AS precision,
             (p * coalesce(tp / nullif(p, 0), 0) + q * coalesce((q - fp) / nullif(q, 0), 0)) / n AS recall,
             (p * coalesce(2 * tp / nullif(2 * tp + fp + p - tp, 0), 0) + q * coalesce(2 * (q - fp) / nullif(2 * (q - fp) + fp + p - tp, 0), 0)) / n AS f1,
             ap AS average_precision, auc AS roc_auc, rp AS r_precision FROM base JOIN rank_ USING (k) JOIN auc_ USING (k)),
tall AS (SELECT k, unnest(['accuracy', 'zero_one_loss', 'precision', 'recall', 'f1', 'average_precision', 'roc_auc', 'r_precision']) AS metric,
                unnest([accuracy, zero_one_loss, precision, recall, f1, average_precision, roc_auc, r_precision]) AS value FROM m)"""

_LABEL_IN = "regexp_matches(lower({text}), '(?:^|[^a-z0-9_])' || lower({label}) || '(?:[^a-z0-9_]|$)')"


def _count(label: str, text: str) -> str:
    """Matches of a label between other than word characters: each such character doubled, so that neighbours don't share one."""
    return f"CAST(len(regexp_extract_all(' ' || regexp_replace(lower({text}), '([^a-z0-9_])', '\\1\\1', 'g') || ' ', '[^a-z0-9_]' || replace(regexp_replace(lower({label}), '([^a-z0-9_ ])', '\\\\\\1', 'g'), ' ', '  ') || '[^a-z0-9_]')) AS BIGINT)"


ORACLE_SQL: dict[str, str] = {
    "tokenize_docs": rf"SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, chr(10))) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM documents)",
    "ngrams_docs": rf"""
        WITH v AS (SELECT doc_id, unnest([text, replace(text, '-', ' '), replace(text, '.', ' '), replace(text, '.', '')]) AS x FROM documents),
        t AS (SELECT doc_id, regexp_extract_all(x, '{_TOKEN}') AS t FROM v),
        g AS (SELECT doc_id, unnest(t) AS g, 1 AS n FROM t UNION SELECT doc_id, t[i] || ' ' || t[i + 1], 2 FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)),
        c AS (SELECT doc_id, count(DISTINCT g) AS ngrams, count(DISTINCT g) FILTER (n = 1) AS unigrams FROM g GROUP BY ALL)
        SELECT doc_id, coalesce(ngrams, 0) AS ngrams, coalesce(unigrams, 0) AS unigrams FROM documents LEFT JOIN c USING (doc_id)""",
    "normalize_docs": r"""
        WITH x AS (SELECT doc_id, text, trim(lower(strip_accents(replace(text, '-', ' '))), E' \t\n\r') AS a, trim(strip_accents(replace(text, '-', ' ')), E' \t\n\r') AS b, trim(lower(replace(text, '-', ' ')), E' \t\n\r') AS c FROM documents)
        SELECT doc_id, md5(CASE WHEN a = '' THEN text ELSE a END) AS all_steps, md5(CASE WHEN b = '' THEN text ELSE b END) AS default_steps, md5(CASE WHEN c = '' THEN text ELSE c END) AS without_accents_step FROM x""",
    "clean_tweets": r"""
        WITH x AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '@[\p{L}\p{N}_]+', ' ', 'g'), 'http://[^\s]+', ' ', 'g'), '[!-/:-@\[-`{-~]', ' ', 'g'), '\bRT\b', ' ', 'g') AS t FROM conversations),
        w AS (SELECT conv_id, turn, i, w[i] AS w FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, string_split(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS w FROM x)))
        SELECT c.conv_id, c.turn, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (length(w) > 1), '') AS clean FROM conversations c LEFT JOIN w USING (conv_id, turn) GROUP BY ALL""",
    "quoted_urls": f"SELECT CAST(p_partkey AS VARCHAR) AS page_id, {_URL} AS url FROM (SELECT p_partkey, p_brand || ' ' || p_name AS title FROM part)",
    "kb_labels": f"WITH {_STAR} SELECT 'en' AS lang, label, label AS norm_label, link_occ, link_doc, text_occ, text_doc FROM label",
    "kb_senses": f"WITH {_STAR} SELECT 'en' AS lang, label, CAST(sense_rank AS INT) AS sense_rank, CAST(l_partkey AS VARCHAR) AS sense_id, occ, doc, CASE WHEN l_partkey % 2 = 0 THEN 'T' ELSE 'F' END AS from_title, CASE WHEN l_partkey % 2 = 0 THEN 'F' ELSE 'T' END AS from_redirect FROM sense",
    "kb_web_labels": rf"""
        WITH a AS (SELECT page_id, regexp_extract(x, '<a href="/([^"]*)">([^<]*)</a>', 2) AS label, regexp_extract(x, '<a href="/([^"]*)">', 1) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/[^"]*">[^<]*</a>')) AS x FROM pages)),
        t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_W}]+')) AS label FROM documents), s AS (SELECT label, count(*) AS o, count(DISTINCT doc_id) AS d FROM t GROUP BY ALL)
        SELECT 'en' AS lang, a.label, count(*) AS link_occ, count(DISTINCT page_id) AS link_doc, coalesce(any_value(o), 0) AS text_occ, coalesce(any_value(d), 0) AS text_doc FROM a LEFT JOIN s USING (label) WHERE a.label <> '' AND target <> '' GROUP BY a.label""",
    "kb_norm_index": f"WITH {_STAR} SELECT lower(label) AS norm_label, string_agg(label, '|' ORDER BY label) AS labels FROM label GROUP BY ALL",
    "title_ngrams": f"WITH {_STAR}, {_GRAMS} SELECT 'en' AS lang, CAST(n AS INT) AS n, ngram, count(*) AS score FROM grams GROUP BY ALL",
    "title_ngrams_head": f"WITH {_STAR}, {_GRAMS} SELECT 'en' AS lang, CAST(n AS INT) AS n, ngram, count(*) AS score FROM grams WHERE i = 1 AND n < len(t) GROUP BY ALL",
    "page_label_shares": """
        WITH o AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY ALL),
        x AS (SELECT CAST(p_partkey AS VARCHAR) AS page_id, unnest([0, 1, 2]) AS pos, unnest([p_name, p_brand, p_type]) AS title, unnest([n, r, a]) AS occurrences FROM part JOIN o ON p_partkey = l_partkey)
        SELECT page_id, CAST(pos AS INT) AS pos, title, occurrences, round(coalesce(occurrences / nullif(sum(occurrences) OVER (PARTITION BY page_id), 0), 0), 9) AS proportion FROM x""",
    "missing_titles": f"WITH {_STAR} SELECT 'en' AS lang, label, CAST(l_partkey AS VARCHAR) AS sense_id FROM sense WHERE l_partkey % 7 = 0",
    "translations": """
        WITH t AS (SELECT p_partkey, 'en' AS tlang, p_brand || ' ' || p_name AS title FROM part UNION ALL SELECT p_partkey, 'de', p_name || ' ' || p_type FROM part UNION ALL SELECT p_partkey, 'fr', p_type || ' ' || p_name FROM part WHERE p_partkey % 2 = 0)
        SELECT CAST(p_partkey AS VARCHAR) AS id, tlang, title, 'http://' || tlang || '.wikipedia.org/wiki/' || replace(replace(title, '#', '%23'), ' ', '%20') AS url FROM t""",
    "link_candidates": f"WITH {_STAR} SELECT request_id, label, count(*) AS links, round(max(lp), 9) AS link_probability, round(sum(sp), 9) AS sense_sum, round(sum(pp), 9) AS prior_sum FROM cand GROUP BY ALL",
    "link_candidates_web": rf"""
        WITH a AS (SELECT page_id, regexp_extract(x, '<a href="/([^"]*)">([^<]*)</a>', 2) AS label, regexp_extract(x, '<a href="/([^"]*)">', 1) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/[^"]*">[^<]*</a>')) AS x FROM pages)),
        l AS (SELECT label, count(*) AS lo, count(DISTINCT page_id) AS ld FROM a GROUP BY ALL), s AS (SELECT label, target, count(*) AS so, count(DISTINCT page_id) AS sd FROM a GROUP BY ALL),
        w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_W}]+')) AS label FROM documents), o AS (SELECT label, count(*) AS t, count(DISTINCT doc_id) AS td FROM w GROUP BY ALL),
        g AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, '{_TOKEN}'), list_concat(regexp_extract_all(replace(text, '-', ' '), '{_TOKEN}'), list_concat(regexp_extract_all(replace(text, '.', ' '), '{_TOKEN}'), regexp_extract_all(replace(text, '.', ''), '{_TOKEN}'))))) AS g FROM documents)
        SELECT CAST(doc_id AS VARCHAR) AS request_id, g AS text, l.label, target AS id, round(coalesce(ld / nullif(td, 0), 0), 9) AS link_probability, round(coalesce(sd / nullif(td, 0), 0), 9) AS sense_probability, round(so / lo, 9) AS prior_probability
        FROM g JOIN l ON lower(strip_accents(replace(g, '-', ' '))) = lower(strip_accents(replace(l.label, '-', ' '))) JOIN s ON s.label = l.label LEFT JOIN o ON o.label = l.label""",
    "link_best": f"WITH {_STAR} SELECT request_id, label, id, title, {_URL} AS url, round(sp, 9) AS sense_probability FROM best",
    "largest_match": f"WITH RECURSIVE {_STAR}, {_GREEDY} SELECT request_id, label, id FROM largest",
    "filter_threshold": f"WITH {_STAR} SELECT request_id, label, id, title, round(lp, 9) AS link_probability, round(sp, 9) AS sense_probability, round(pp, 9) AS prior_probability, link_doc AS \"linkDocCount\" FROM cand WHERE link_doc >= 5 AND sp > 0.03",
    "filter_unique": f"""WITH RECURSIVE {_STAR}, {_GREEDY},
        u AS (SELECT CAST(o_custkey AS VARCHAR) AS context, title, request_id, label, id, row_number() OVER (PARTITION BY o_custkey, title ORDER BY l_orderkey, sp DESC, label, id) AS k FROM largest JOIN orders ON o_orderkey = l_orderkey)
        SELECT context, title, request_id, label, id FROM u WHERE k = 1""",
    "links_json": f"WITH RECURSIVE {_STAR}, {_GREEDY} SELECT CAST(txt.l_orderkey AS VARCHAR) AS request_id, count(largest.id) AS links FROM txt LEFT JOIN largest USING (l_orderkey) GROUP BY txt.l_orderkey",
    "article_inlinks": f"WITH {_STAR}, {_FOLLOWS} SELECT CAST(b AS VARCHAR) AS page_id, count(*) AS inlinks, md5(string_agg(a || ':' || title, '|' ORDER BY a)) AS digest FROM follows JOIN page ON p_partkey = a GROUP BY b",
    "link_relatedness": f"""WITH {_FOLLOWS}, n AS (SELECT a, count(*) AS n FROM follows GROUP BY ALL), c AS (SELECT f.a, f.b, count(*) AS c FROM follows f JOIN follows x ON x.a = f.a JOIN follows y ON y.a = f.b AND y.b = x.b GROUP BY ALL)
        SELECT CAST(f.a AS VARCHAR) AS page_id, CAST(f.b AS VARCHAR) AS target_id, round(CASE WHEN c IS NULL THEN 0 WHEN c = x.n AND c = y.n THEN 1
               ELSE least(1.0, greatest(0.0, 1 - (ln(greatest(x.n, y.n)) - ln(c)) / (ln((SELECT count(*) FROM part)) - ln(least(x.n, y.n))))) END, 9) AS relatedness
        FROM follows f JOIN n x ON x.a = f.a LEFT JOIN n y ON y.a = f.b LEFT JOIN c ON c.a = f.a AND c.b = f.b""",
    "article_parts": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS category, '<b>' || p_name || '</b> of ' || p_brand || '. A ' || p_type || ' ' || p_name || '.' AS definition, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 3::BIGINT ELSE 0::BIGINT END AS labels FROM part",
    "anchor_features": f"""WITH {_STAR}, {_GRAMS}, s AS (SELECT ngram, count(*) AS score FROM grams GROUP BY ALL), n AS (SELECT count(*) AS n FROM part),
        lg AS (SELECT label, unnest([string_split(label, ' ')[1], string_split(label, ' ')[2], label]) AS ngram FROM label), a AS (SELECT label, coalesce(sum(score), 0) AS sncl FROM lg LEFT JOIN s USING (ngram) GROUP BY ALL)
        SELECT label.label, 2.0::DOUBLE AS len, round(coalesce(ln(n / (s.score + 0.00001)), 0), 9) AS idf_title, round(ln(n / (link_doc + 0.00001)), 9) AS idf_anchor, round(ln(n / (text_doc + 0.00001)), 9) AS idf_content,
               round(link_doc / (text_doc + 0.00001), 9) AS keyphraseness, round(link_occ / (text_occ + 0.00001), 9) AS linkprob, 0.0::DOUBLE AS snil, CAST(sncl AS DOUBLE) AS sncl, round(levenshtein(label.label, upper(label.label)) / length(label.label), 9) AS normalization
        FROM label CROSS JOIN n JOIN a USING (label) LEFT JOIN s ON s.ngram = label.label""",
    "article_features": f"""WITH {_STAR}, x AS (SELECT label, CAST(l_partkey AS VARCHAR) AS id, l_partkey % 2 = 0 AS even, title, label || ' of ' || p_brand || '. A ' || p_type || ' ' || label || '.' AS d, string_split(label, ' ') AS lw, regexp_split_to_array(title, '[^A-Za-z0-9_]+') AS tw
             FROM sense JOIN page ON p_partkey = l_partkey JOIN part USING (p_partkey))
        SELECT label, id, CAST(even AS BIGINT) AS redirect, {_count("label", "title")} AS tf_title, {_count("label", "split_part(d, '.', 1)")} AS tf_sentence, {_count("label", "d")} AS tf_paragraph,
               0::BIGINT AS pos_first_in_paragraph, CAST({_count("title", "label")} > 0 AS BIGINT) AS nct, CAST({_count("label", "title")} > 0 AS BIGINT) AS tcn, CAST(label = title AS BIGINT) AS ten,
               CAST(lw[1] = tw[1] AS BIGINT) AS substring_match_1, CAST(lw[-1] = tw[-1] AS BIGINT) AS substring_match_2, CAST(len(list_distinct(list_intersect(lw, tw))) AS BIGINT) AS word_match,
               CAST(len(lw) + len(tw) - 2 * len(list_distinct(list_intersect(lw, tw))) AS BIGINT) AS word_miss, CAST(levenshtein(label, title) AS BIGINT) AS edit_distance FROM x""",
    "multi_outlinks": _overlap("SELECT a AS page, b AS other FROM follows"),
    "multi_inlinks": _overlap("SELECT b AS page, a AS other FROM follows"),
    "multi_tier_one": f"""WITH {_STAR} SELECT request_id, label, id, 1.0::DOUBLE AS label_overlap, 1.0::DOUBLE AS label_unique, 1.0::DOUBLE AS entity_overlap, 1.0::DOUBLE AS entity_unique, 1.0::DOUBLE AS entity_proportion,
               round(sp, 9) AS sense_prob_sum, round(pp, 9) AS prior_prob_sum, round(lp, 9) AS cmns_sum FROM best""",
    "pageview_windows": f"WITH {_VIEWS} SELECT * FROM w",
    "pageview_trends": f"WITH {_VIEWS} SELECT title, day, round(CASE WHEN views_week > 0 THEN views_day / views_week ELSE 0 END, 9) AS trend_day, round(CASE WHEN views_4week > 0 THEN views_week / views_4week ELSE 0 END, 9) AS trend_week, round(CASE WHEN views_year > 0 THEN views_4week / views_year ELSE 0 END, 9) AS trend_4week FROM w",
    "context_edges": f"{_GRAPH} SELECT context, src, dst, t FROM graph",
    "context_degree": f"{_GRAPH} SELECT context, node, degree, round(CASE WHEN n > 1 THEN degree / (n - 1) ELSE 1 END, 9) AS degree_centrality FROM nodes",
    "context_pagerank": f"{_GRAPH}, {_round(1)}, {_round(2)}, {_round(3)} SELECT context, node, round(r + 1e-12, 9) AS pagerank, round(r * n + 1e-12, 9) AS pagerank_normalized FROM r3",
    "feedback_join": f"WITH {_HISTORY} SELECT context, id, CASE WHEN feedback = 'positive' THEN 'positive' WHEN feedback = 'negative' OR num % 3 = 0 THEN 'negative' ELSE 'unknown' END AS feedback FROM hist",
    "evaluate_counts": f"""WITH {_HISTORY}, s AS (SELECT context, request_id, feedback FROM hist UNION ALL SELECT '*', request_id, feedback FROM hist)
        SELECT context, count(DISTINCT request_id) AS requests, count(*) AS links, count(*) FILTER (feedback IS NULL) AS missing, count(*) FILTER (feedback = 'positive') AS positive, count(*) FILTER (feedback = 'negative') AS negative FROM s GROUP BY ALL""",
    "evaluate_metrics": f"""WITH {_HISTORY}, {_METRICS} SELECT CASE k WHEN '*' THEN 'micro' ELSE 'context' END AS scope, k AS context, metric, round(value, 9) AS value FROM tall
        UNION ALL SELECT 'macro', '*', metric, round(avg(value), 9) FROM tall WHERE k <> '*' GROUP BY ALL""",
    "stream_unique": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS context, event_type AS title FROM events",
    "stream_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
