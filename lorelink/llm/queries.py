"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, nndescent, packing, pii, pq, quality, simhash, sketch, spelling, topk, urlfilter, warc
from .common import held_out_rows, learning_rows, settled, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer of op3 and of the pipeline.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The rules of op5, as its contract states them.
URL_RULES = (
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = langid.train(docs.where(learning_rows(F.col("doc_id"), 3, 1)))
    return langid.predict(docs.select("doc_id", "text", held_out_rows(F.col("doc_id"), 3, 1).alias("held_out")), net, ["doc_id", "held_out"])


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of each embedding whose id is divisible by 50, against every other row."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(topk.finite(F.col("embedding")))
    weighted = vectors.select("vec_id", topk.floor_weights(F.col("embedding")).alias("weights"))
    return topk.top_k(weighted, F.col("vec_id") % 50 == 0, 5)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER, 2048)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, equal payloads stored once, written and read back."""
    path = warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_path(spark, "warc"))
    return warc.resolved(settled(warc.read_archives(spark, path), "warc-headers"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, keep=["page_id"])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by patterns and by the network."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.span_digest(pii.find_pii(docs, pii.train(docs), ["doc_id"]), ["doc_id"])


def op7_mix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document, sources weighing 3, 1, 2 in turn."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(settled(sized, "sizes"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality").where(learning_rows(F.col("doc_id"), 5, 0)))
    return quality.score_quality(docs.withColumn("held_out", held_out_rows(F.col("doc_id"), 5, 0)), field, ["doc_id", "held_out"])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), errors=4, width=4)


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"), width=5)


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of each embedding whose id is divisible by 50, by greedy search in a neighbour graph."""
    return nndescent.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word's near words and the word that it is a variant of."""
    return spelling.variant_groups(table(spark, sf_dir, "documents", "doc_id", "text"), least=5, occurrences=3, drop=97)


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every embedding, 4 parts of 256 entries, after 4 rounds."""
    return pq.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES: dict[str, Query] = {"op1_language_id": op1_language_id, "op2_exact_topk": op2_exact_topk, "op3_best_two_fit": op3_best_two_fit, "op4_warc_revisits": op4_warc_revisits, "op5_url_filter": op5_url_filter, "op6_personal_data": op6_personal_data, "op7_mix_budgets": op7_mix_budgets, "op8_line_quality": op8_line_quality, "op9_simhash_near_dedup": op9_simhash_near_dedup, "op10_scaled_sketch": op10_scaled_sketch, "op11_nn_descent": op11_nn_descent, "op12_spelling_variants": op12_spelling_variants, "op13_annular_codes": op13_annular_codes}


def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Rounds of assignment and means, one after another, over whole vectors."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, p.part, CAST(min(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)) * {entries} AS BIGINT) AS d,
              min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)) * {entries} + entry) AS m FROM p JOIN c{k} c ON p.part = c.part GROUP BY rid, p.part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (
                SELECT p.part, CAST(m AS BIGINT) % {entries} AS entry, CAST(unnest(x) AS BIGINT) AS x, generate_subscripts(x, 1) AS i FROM p JOIN a{k} USING (rid, part)) GROUP BY ALL),
            o{k} AS (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM c{k}),
            c{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, list(CAST(CASE WHEN n IS NULL THEN o.x ELSE (s - ((s % n) + n) % n) // n END AS DOUBLE) ORDER BY o.i) AS x
                FROM o{k} o LEFT JOIN s{k} s ON o.part = s.part AND o.entry = s.entry AND o.i = s.i GROUP BY o.part, o.entry)""")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT rid, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(part)),
        c0 AS (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {entries}),
        {", ".join(steps)},
        b AS (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM c{rounds}),
        h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b),
        e AS (SELECT rid, string_agg(lower(printf('%02x', CAST(m AS BIGINT) % {entries})), '' ORDER BY part) AS code, CAST(sum(d) // {entries} AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), h"""


#: CRC-32 is linear: that of a text is the xor of what its bytes make by their distance from the end, and that of as many zero bytes.
_SPELLING_SQL = """
        WITH RECURSIVE t0 AS MATERIALIZED (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(b)),
        t AS (SELECT 0 AS k, b, v FROM t0 UNION ALL SELECT k + 1, t.b, xor(t.v >> 8, t0.v) FROM t JOIN t0 ON t0.b = t.v & 255 WHERE k < 255),
        z AS (SELECT 0 AS k, 4294967295::BIGINT AS v UNION ALL SELECT k + 1, xor(z.v >> 8, t0.v) FROM z JOIN t0 ON t0.b = z.v & 255 WHERE k < 255),
        d AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM d GROUP BY ALL),
        y AS (SELECT id, w, n, hex(encode(id || ':' || w)) AS x FROM r),
        g AS (SELECT id, w, n, length(x) // 2 AS size, x, unnest(range(length(x) // 2)) AS i FROM y WHERE x IS NOT NULL),
        h AS (SELECT id, w, any_value(n) AS n, any_value(size) AS size, bit_xor(v) AS v FROM g JOIN t ON t.k = size - 1 - i AND t.b = CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) GROUP BY id, w),
        c AS (SELECT w, n, xor(xor(h.v, z.v), 4294967295) AS h FROM h JOIN z ON z.k = size UNION ALL SELECT w, n, 1 FROM r WHERE id IS NULL),
        e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM c),
        vocab AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        m AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
        near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM m a JOIN m b ON a.i = b.i AND substr(a.word, 1, a.i - 1) = substr(b.word, 1, b.i - 1) AND substr(a.word, a.i + 1) = substr(b.word, b.i + 1) AND a.word <> b.word AND length(a.word) = length(b.word)
                 UNION SELECT m.word, m.n, s.word, s.n FROM m JOIN vocab s ON s.word = substr(m.word, 1, i - 1) || substr(m.word, i + 1)
                 UNION SELECT s.word, s.n, m.word, m.n FROM m JOIN vocab s ON s.word = substr(m.word, 1, i - 1) || substr(m.word, i + 1)),
        best AS (SELECT word, count(*) AS n_near, arg_max(near, near_n * 1000000 - rank) AS form, max(near_n) AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY encode(near)) AS rank FROM near) GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM vocab v LEFT JOIN best USING (word)),
        up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f AS e ON e.word = up.root WHERE e.form IS NULL"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
        WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        bad AS (SELECT DISTINCT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x)),
        t AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM e WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
              FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_warc_revisits": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m""",
    "op5_url_filter": r"""
        WITH r(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        x AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
        SELECT page_id, host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, coalesce(arg_max(verdict, length(h || p) * 1000 + length(h)), 'allow') AS verdict
        FROM x LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path""",
    "op12_spelling_variants": _SPELLING_SQL,
    "op13_annular_codes": _codes_sql(),
}
