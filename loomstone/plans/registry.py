"""Queries over whole tables, and their SQL.

The supplied tables stand in for catalog tables: documents are documents of one section each, conversations are
documents whose turns are versions, events are history, runs and cache entries, benchmark texts are queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions import text as T
from ..operators import audit, catalog, evaluate, paging, retention, search, sections, vectors, webrank
from ..operators.pages import extracted
from ..sources.readers import table
from ..sources.sinks import shared_folder
from ..streaming.jobs import redacted_history

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- text functions -----------------------------------------------------------------------------


@query("""
    SELECT doc_id, length(text) AS characters, len(regexp_extract_all(text, '\\S+')) AS words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS estimate, sha256(text) AS hash,
           'doc_' || substr(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 1, 24) AS public_id,
           CASE WHEN length(text) > 512 THEN rtrim(substr(text, 1, 511), chr(32) || chr(10)) || '…' ELSE text END AS cut
    FROM documents
""")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(x).cast("long").alias("characters"), T.token_count(x).cast("long").alias("words"), T.token_estimate(x).alias("estimate"), T.sha256(x).alias("hash"),
        T.public_id(F.col("source"), F.col("doc_id").cast("string")).alias("public_id"), T.truncate_ellipsis(x, 512).alias("cut"),
    )


@query("""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(?i)Bearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b', '[REDACTED]', 'g'),
        '\\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16})\\b', '[REDACTED]', 'g'),
        '(?i)(\\b(?:authorization|credential|password|passwd|secret|token|access[-_]?token|refresh[-_]?token|api[-_]?key|signature|sig)\\s*[=:]\\s*)("[^"]*"|''[^'']*''|[^\\s&,;]+)', '\\1[REDACTED]', 'g') AS text
    FROM documents
""")
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


_PARTS = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
_URLS = f"""
    u AS (SELECT page_id, url, html, lower(regexp_extract(url, {_PARTS}, 1)) AS scheme, regexp_replace(lower(regexp_extract(url, {_PARTS}, 2)), ':\\d*$', '') AS host,
                 regexp_replace(regexp_extract(url, {_PARTS}, 3), '/+$', '') AS path, regexp_extract(url, {_PARTS}, 4) AS ask FROM pages),
    kept AS (SELECT *, list_filter(string_split(ask, '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('dclid','fbclid','gclid','mc_cid','mc_eid','msclkid','_hsenc','_hsmi')) AS pairs FROM u),
    ordered AS (SELECT *, list_transform(list_sort(list_transform(pairs, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}})), lambda s: s.p) AS sorted FROM kept),
    c AS (SELECT page_id, url, html, host, path, scheme, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(sorted) = 0 THEN '' ELSE '?' || array_to_string(sorted, '&') END AS canonical FROM ordered)
"""


@query(f"WITH {_URLS} SELECT page_id, canonical, host FROM c")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"))


@query(f"""
    WITH {_URLS}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY length(html) DESC, lower(url), page_id) AS k FROM c),
    best AS (SELECT host, canonical, page_id, length(html) AS n, url FROM r WHERE k = 1)
    SELECT host, canonical, page_id, CAST(row_number() OVER (PARTITION BY host ORDER BY n DESC, lower(url), page_id) AS BIGINT) AS position FROM best
""")
def deduplicated_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(
        "page_id", F.col("page_id").alias("rank"), F.col("url").alias("title"), urls.canonical_url(F.col("url")).alias("url"), urls.host(F.col("url")).alias("query_id"), F.length("html").alias("score"),
    )
    found = webrank.ranked(rows, None)
    return found.select(F.col("query_id").alias("host"), F.col("url").alias("canonical"), "page_id", F.col("position").cast("long"))


@query(f"""
    WITH {_URLS}, parts AS (SELECT page_id, scheme, list_concat(string_split(host, '.'), string_split(lower(path), '/')) AS p, host FROM c)
    SELECT page_id, CASE WHEN list_has_any(p, ['blog', 'community', 'forum']) THEN 'THIRD_PARTY'
        WHEN list_has_any(p, ['api', 'developer', 'developers', 'docs', 'documentation', 'learn', 'reference', 'support']) THEN 'LIKELY_OFFICIAL' ELSE 'UNKNOWN' END AS class FROM parts
""")
def trust_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", rules.trust_class(F.col("url"), F.lit(False)).alias("class"))


@query("""
    WITH t AS (SELECT source, string_split(source, '') AS cs FROM (SELECT DISTINCT source FROM documents))
    SELECT source, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(cs, lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM t
""")
def fnv_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().select("source", T.fnv1a(F.col("source")).alias("hash"))


# --- sections, postings, search -----------------------------------------------------------------


def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("section_id"), "doc_id", F.concat_ws(" ", "source", "lang").alias("title"), F.lit("").alias("heading"), F.lit("").alias("heading_path"), F.col("text").alias("content"),
        F.lit(0).alias("ordinal"), F.col("source").alias("source_key"), F.col("lang").alias("language"),
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""
    WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents)
    SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t GROUP BY term
""")
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    found = sections.postings(document_sections(spark, sf), ["content"])
    return found.groupBy("term", "section_id").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


# A query is a whole text: each of its distinct words is a phrase of one token or several, which stand next to each other in one field.
_BM25 = f"""
    s AS (SELECT doc_id AS section_id, source || ' ' || lang AS title, text FROM documents),
    f AS (SELECT section_id, 'title' AS field, {_TOKENS.format('title')} AS tok FROM s UNION ALL SELECT section_id, 'content', {_TOKENS.format('text')} FROM s),
    p AS (SELECT section_id, field, unnest(tok) AS term, unnest(range(1, len(tok) + 1)) AS pos FROM f),
    len AS (SELECT section_id, sum(len(tok)) AS n FROM f GROUP BY 1 HAVING sum(len(tok)) > 0), st AS (SELECT count(*) AS cnt, avg(n) AS mean FROM len),
    bench AS (SELECT item_id AS query_id, text AS query FROM benchmark),
    w AS (SELECT query_id, unnest(list_distinct(regexp_split_to_array(replace(lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')), '"', ''), '\\s+'))) AS word FROM bench),
    q AS (SELECT query_id, word, {_TOKENS.format('word')} AS toks FROM w), qt AS (SELECT * FROM q WHERE len(toks) > 0), ph AS (SELECT DISTINCT word, toks FROM qt),
    places AS (SELECT word, section_id FROM ph JOIN p ON p.term = toks[1] WHERE len(toks) = 1
               UNION ALL SELECT word, p.section_id FROM ph JOIN p ON p.term = toks[1] JOIN f ON f.section_id = p.section_id AND f.field = p.field WHERE len(toks) > 1 AND list_slice(f.tok, pos, pos + len(toks) - 1) = toks),
    tf AS (SELECT word, section_id, count(*) AS tf FROM places GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
    need AS (SELECT query_id, count(*) AS k FROM qt GROUP BY 1),
    met AS (SELECT query_id, section_id, word, tf FROM qt JOIN tf USING (word)),
    full_ AS (SELECT query_id, section_id FROM met JOIN need USING (query_id) GROUP BY query_id, section_id, k HAVING count(*) = k),
    bm AS (SELECT query_id, section_id, round(-sum(greatest(ln((cnt - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 8) AS rank
           FROM met JOIN full_ USING (query_id, section_id) JOIN df USING (word) JOIN len USING (section_id), st GROUP BY 1, 2)
"""
_HITS = """
    hits AS (SELECT b.query_id, section_id, rank, CASE WHEN contains(lower(title), lower(query)) THEN 4 ELSE 1 END AS score, title FROM bm b JOIN bench USING (query_id) JOIN s USING (section_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, score DESC, lower(title), section_id) AS position FROM hits)
"""


@query(f"WITH {_BM25} SELECT query_id, section_id, round(rank, 5) AS rank FROM bm")
def bm25_matches(spark: SparkSession, sf: str) -> DataFrame:
    index = search.Index.build(document_sections(spark, sf))
    return search.bm25(benchmark_queries(spark, sf), index).select("query_id", "section_id", F.round("rank", 5).alias("rank"))


@query(f"""
    WITH {_BM25}, {_HITS},
    rest AS (SELECT * FROM bench WHERE query_id NOT IN (SELECT query_id FROM hits)),
    sub AS (SELECT query_id, section_id, CAST(NULL AS DOUBLE) AS rank, CASE WHEN contains(lower(title), lower(query)) THEN 4 ELSE 1 END AS score, title
            FROM rest, s WHERE contains(lower(title), lower(query)) OR contains(lower(text), lower(query))),
    subbest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), section_id) AS position FROM sub)
    SELECT query_id, CAST(position AS BIGINT) AS position, section_id, score FROM best WHERE position <= 10
    UNION ALL SELECT query_id, CAST(position AS BIGINT), section_id, score FROM subbest WHERE position <= 10
""")
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    index = search.Index.build(document_sections(spark, sf))
    return search.search(benchmark_queries(spark, sf), index).select("query_id", F.col("position").cast("long"), "section_id", "score")


# The snippet of a hit: of windows of 160 characters around the query's words (32 words, 16 places each) the one with the most of them, then the tightest, then the first.
_SNIPPETS = """
    shown AS (SELECT query_id, section_id, position, score, rank, title, query, coalesce(text, '') AS content FROM found JOIN bench USING (query_id) JOIN (SELECT section_id, text FROM s) USING (section_id)),
    wanted AS (SELECT DISTINCT query_id, unnest(list_slice(list_distinct_ordered, 1, 32)) AS word FROM (SELECT query_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_ordered
               FROM (SELECT query_id, regexp_extract_all(strip_accents(lower(query)), '[\\p{L}\\p{N}]+') AS ws FROM bench))),
    runs AS (SELECT query_id, section_id, unnest(ps) AS word, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT query_id, section_id, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS ps FROM shown)),
    at_ AS (SELECT *, sum(length(word)) OVER (PARTITION BY query_id, section_id ORDER BY i) - length(word) AS a FROM runs),
    hit_ AS (SELECT query_id, section_id, word, a, row_number() OVER (PARTITION BY query_id, section_id, word ORDER BY a) AS k FROM at_ JOIN wanted USING (query_id, word)),
    spots AS (SELECT query_id, section_id, word, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(word) AS e FROM hit_ WHERE k <= 16),
    opens AS (SELECT DISTINCT query_id, section_id, least(greatest(0, a - 80), greatest(0, length(content) - 160)) AS b FROM spots JOIN shown USING (query_id, section_id)),
    weighed AS (SELECT o.query_id, o.section_id, b, count(DISTINCT word) AS n, least(max(e), b + 160) - min(a) AS width FROM opens o JOIN spots p ON p.query_id = o.query_id AND p.section_id = o.section_id AND a >= b AND a < b + 160 GROUP BY 1, 2, 3),
    picked AS (SELECT query_id, section_id, arg_min(b, (-n, width, b)) AS b FROM weighed GROUP BY 1, 2),
    raw AS (SELECT shown.*, coalesce(b, 0) AS b, regexp_replace(substr(content, CAST(coalesce(b, 0) + 1 AS BIGINT), 320), '^\\s+|\\s+$', '', 'g') AS r FROM shown LEFT JOIN picked USING (query_id, section_id)),
    body AS (SELECT *, CASE WHEN length(r) <= 160 THEN r ELSE regexp_replace(substr(r, 1, 159), '\\s+$', '') || '…' END AS body FROM raw),
    snip AS (SELECT *, CASE WHEN b > 0 THEN '…' ELSE '' END || body || CASE WHEN b + 320 < length(content) AND NOT ends_with(body, '…') THEN '…' ELSE '' END AS snippet FROM body)
"""


@query(f"""
    WITH {_BM25}, {_HITS},
    rest AS (SELECT * FROM bench WHERE query_id NOT IN (SELECT query_id FROM hits)),
    sub AS (SELECT query_id, section_id, CAST(NULL AS DOUBLE) AS rank, CASE WHEN contains(lower(title), lower(query)) THEN 4 ELSE 1 END AS score, title FROM rest, s WHERE contains(lower(title), lower(query)) OR contains(lower(text), lower(query))),
    found AS (SELECT query_id, section_id, rank, score, title, position FROM best WHERE position <= 10
              UNION ALL SELECT query_id, section_id, rank, score, title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), section_id) AS position FROM sub QUALIFY position <= 10), {_SNIPPETS}
    SELECT query_id, CAST(position AS BIGINT) AS position, section_id, title, title AS heading, split_part(title, ' ', 1) AS source_key, split_part(title, ' ', 2) AS language, score, round(rank, 5) AS rank, snippet FROM snip
""")
def search_with_snippets(spark: SparkSession, sf: str) -> DataFrame:
    index = search.Index.build(document_sections(spark, sf))
    found = search.projected(search.with_snippets(search.search(benchmark_queries(spark, sf), index)))
    return found.withColumns({"position": F.col("position").cast("long"), "rank": F.round("rank", 5)})


# Features of a text and their hashed places, as for the hashed vectors.
_HASHED = f"""
    list_filter(regexp_extract_all(lower(strip_accents({{}})), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({T.STOP_WORDS}, x))
"""
_STEM = "t"
for _ending, _new in T.SUFFIXES:
    _STEM = f"regexp_replace({_STEM}, '{_ending}', '{_new}')"
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"""
    WITH {_BM25}, {_HITS}, found AS (SELECT query_id, section_id, rank, score, title, position FROM best WHERE position <= 40), {_SNIPPETS},
    texts AS (SELECT query_id, section_id, 0 AS side, {_HASHED.format("title || ' ' || snippet || ' ' || content")} AS ts FROM snip UNION ALL SELECT query_id, section_id, 1, {_HASHED.format('query')} FROM snip),
    fe AS (SELECT query_id, section_id, side, unnest(ts) AS f, 1.0 AS w FROM texts UNION ALL SELECT query_id, section_id, side, {_STEM}, 0.6 FROM (SELECT query_id, section_id, side, unnest(ts) AS t FROM texts)
           UNION ALL SELECT query_id, section_id, side, ts[i] || ' ' || ts[i + 1], 0.75 FROM (SELECT query_id, section_id, side, ts, unnest(range(1, len(ts))) AS i FROM texts)),
    fh AS (SELECT query_id, section_id, side, w, {_FNV.format('f')} AS h FROM fe),
    fp AS (SELECT query_id, section_id, side, h % 64 AS place, CAST(sum(CASE WHEN h % 2 = 0 THEN w ELSE -w END) AS DOUBLE) AS v FROM fh GROUP BY 1, 2, 3, 4), fn AS (SELECT query_id, section_id, side, sqrt(sum(v * v)) AS norm FROM fp GROUP BY 1, 2, 3),
    unit AS (SELECT query_id, section_id, side, place, CASE WHEN norm > 0 THEN v / norm ELSE 0 END AS v FROM fp JOIN fn USING (query_id, section_id, side)),
    near AS (SELECT a.query_id, a.section_id, greatest(0.0, sum(a.v * b.v)) AS near FROM unit a JOIN unit b ON a.query_id = b.query_id AND a.section_id = b.section_id AND a.place = b.place AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
    mixed AS (SELECT query_id, section_id, position, 0.65 * score / greatest(1, max(score) OVER (PARTITION BY query_id)) + 0.35 * coalesce(near, 0) AS combined FROM found LEFT JOIN near USING (query_id, section_id))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 8) DESC, position) AS new_position, section_id, round(combined, 5) AS combined FROM mixed QUALIFY new_position <= 10
""")
def reranked_search(spark: SparkSession, sf: str) -> DataFrame:
    index = search.Index.build(document_sections(spark, sf))
    hits = search.with_snippets(search.search(benchmark_queries(spark, sf), index, limit=50, fallback=False))
    return vectors.reranked(hits).select("query_id", F.col("new_position").cast("long"), "section_id", F.round("combined", 5).alias("combined"))


# Names under which the same was asked before.
for _name in ("bm25_matches", "document_search", "search_with_snippets", "reranked_search"):
    QUERIES[f"whole_text_{_name}"] = QUERIES[_name]
    if _name in SQL:
        SQL[f"whole_text_{_name}"] = SQL[_name]


_CHANGED = """
    c AS (SELECT doc_id, CASE WHEN doc_id % 20 = 3 THEN coalesce(text, '') || ' quagga ' || lang ELSE text END AS text FROM documents WHERE doc_id % 20 <> 7)
"""


@query(f"""
    WITH {_CHANGED}, t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM c),
    asked AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS term FROM benchmark UNION SELECT 'quagga')
    SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t SEMI JOIN asked USING (term) GROUP BY term
""")
def kept_index_update(spark: SparkSession, sf: str) -> DataFrame:
    """A kept index in which one document in twenty changed and one went; the postings of benchmark words, from their buckets."""
    rows = document_sections(spark, sf).withColumn("title", F.lit(""))
    path = f"{shared_folder(spark)}/loomstone/index-{uuid.uuid4().hex}"
    search.Index.build(rows).save(path)
    new = rows.where("doc_id % 20 = 3").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" quagga "), "language"))
    search.Index.update(spark, path, rows.where("doc_id % 20 = 7").select("doc_id"), new)
    asked = search.tokens_of(benchmark_queries(spark, sf)).select("term").union(spark.createDataFrame([("quagga",)], "term string")).distinct()
    found = search.Index.load(spark, path, asked).postings.join(asked, "term", "left_semi")
    return found.groupBy("term", "section_id").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@query(f"""
    WITH w AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS word FROM benchmark), k AS (SELECT DISTINCT substr(word, 2, length(word) - 2) AS core FROM w WHERE length(word) BETWEEN 3 AND 6)
    SELECT core, count(*) AS n FROM k, documents WHERE contains(lower(text), core) GROUP BY core
""")
def word_cores(spark: SparkSession, sf: str) -> DataFrame:
    """Substrings within words: the inner letters of every short benchmark word, one letter and more, in all documents."""
    words = search.tokens_of(benchmark_queries(spark, sf)).select("term").distinct().where("length(term) between 3 and 6")
    cores = words.selectExpr("substring(term, 2, length(term) - 2) as query").distinct().withColumn("query_id", F.col("query"))
    found = search.containing(document_sections(spark, sf), cores, ["content"])
    return found.groupBy(F.col("query_id").alias("core")).agg(F.count("*").alias("n"))


@query("""
    SELECT item_id AS query_id, doc_id AS section_id FROM benchmark b, documents d WHERE contains(lower(d.text), lower(trim(b.text)))
""")
def substring_matches(spark: SparkSession, sf: str) -> DataFrame:
    return search.containing(document_sections(spark, sf), benchmark_queries(spark, sf), ["content"]).select("query_id", "section_id")


@query("""
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
    parts AS (SELECT doc_id, n, text, unnest(generate_series(0, CASE WHEN n <= 12000 THEN 0 ELSE CAST(ceil((n - 12000) / 11600.0) AS BIGINT) END)) AS part FROM d),
    cut AS (SELECT doc_id, part, CASE WHEN n <= 12000 THEN text ELSE regexp_replace(substr(text, CAST(part * 11600 + 1 AS BIGINT), 12000), '^\\s+|\\s+$', '', 'g') END AS content FROM parts)
    SELECT doc_id, part AS ordinal, length(content) AS character_count, sha256(content) AS content_hash, CASE WHEN part > 0 THEN 'document-part-' || (part + 1) ELSE 'document' END AS anchor FROM cut
""")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.lit("document").alias("anchor"), F.col("text").alias("content"))
    return sections.chunked(sections.measured(d)).select("doc_id", F.col("ordinal").cast("long"), F.col("character_count").cast("long"), "content_hash", "anchor")


@query()
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    pages = extracted(table(spark, sf, "pages"))
    return sections.sections(pages.select(F.col("page_id").alias("doc_id"), "title", F.col("markdown").alias("text")), "page")


# Pages as text, from the markup that the supplied pages have: what frames them or runs goes, blocks become lines. Their links are all in the navigation.
_PAGE_TEXT = f"""
    {_URLS},
    cut AS (SELECT page_id, coalesce(html, '') AS h, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?(?:-->|$)', '', 'gs'), '(?i)<script[ >].*?(?:</script>|$)|<style[ >].*?(?:</style>|$)|<nav[ >].*?(?:</nav>|$)|<footer[ >].*?(?:</footer>|$)|<title>.*?(?:</title>|$)', '', 'gs') AS x FROM pages),
    flat AS (SELECT page_id, h, regexp_replace(regexp_replace(x, '[ \\t\\r\\f\\v\\n]+', ' ', 'g'), '(?i)<!doctype[^>]*>|</?(?:html|head|body|meta|b)(?: [^>]*)?>', '', 'g') AS x FROM cut),
    cuts AS (SELECT page_id, h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<h1>', chr(10) || chr(10) || '# ', 'g'), '(?i)</h1>|</?(?:p|div|article)(?: [^>]*)?>', chr(10) || chr(10), 'g'), '(?i)<br */?>', chr(10), 'g'), '(?i)&quot;', '"', 'g') AS x FROM flat),
    told AS (SELECT page_id, replace(replace(replace(regexp_extract(h, '(?is)<title>(.*?)(?:</title>|$)', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS t, replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM cuts),
    read_ AS (SELECT told.page_id, c.url, coalesce(nullif(substr(regexp_replace(regexp_replace(replace(t, '&amp;', '&'), '[ \\t\\r]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 512), ''), host) AS title, canonical AS canonical_url,
              regexp_replace(regexp_replace(regexp_replace(x, ' *' || chr(10) || ' *', chr(10), 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown FROM told JOIN c ON c.page_id = told.page_id)
"""


@query(f"WITH {_PAGE_TEXT} SELECT page_id, url, title, canonical_url, markdown, '' AS links FROM read_")
def page_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(table(spark, sf, "pages")).withColumn("links", F.array_join("links", " "))


_TOLD = "list_filter(regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}.]+'), lambda t: length(t) >= 2)"
_ALLOWED = "least(5000, left_ - CASE WHEN taken > 0 THEN 2 ELSE 0 END)"


@query(f"""
    WITH RECURSIVE t AS (SELECT conv_id, turn, role || ' ' || turn AS heading, translate(coalesce(text, ''), '#`~' || chr(13) || chr(9), '     ') AS x FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, heading, x) - 1 AS i, last_value(x) OVER (PARTITION BY conv_id ORDER BY turn, heading, x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ask FROM t),
    b AS (SELECT conv_id, i, heading, regexp_replace(regexp_replace(x, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body, list_distinct(list_slice({_TOLD.format('ask')}, 1, 64)) AS terms FROM k),
    w AS (SELECT *, '# ' || heading || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END AS shown, list_intersect(terms, list_slice({_TOLD.format("heading || ' ' || body")}, 1, 2048)) AS hit, list_slice({_TOLD.format('heading')}, 1, 64) AS head FROM b),
    r AS (SELECT *, CASE WHEN len(terms) = 0 THEN 1.0 / (i + 1) WHEN len(hit) = 0 THEN 0 ELSE least(1.0, list_sum(list_transform(hit, lambda h: 1.0 + CASE WHEN list_contains(head, h) THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(h, '^v?\\d+(?:\\.\\d+)+$') THEN 0.25 ELSE 0 END)) / greatest(1.0, len(terms) * 1.75 + 0.1)) END AS score FROM w),
    o AS (SELECT conv_id, shown, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, i) AS n, count(*) OVER (PARTITION BY conv_id) AS kept FROM r WHERE score > 0),
    f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(400 AS BIGINT) AS left_, false AS stopped, CAST(0 AS BIGINT) AS taken, '' AS text, false AS clipped FROM k
          UNION ALL SELECT conv_id, n, CASE WHEN stop THEN left_now ELSE left_now - length(value) END, stop, CASE WHEN stop THEN taken ELSE taken + 1 END, CASE WHEN stop THEN text WHEN taken = 0 THEN value ELSE text || chr(10) || chr(10) || value END, CASE WHEN stop THEN clipped ELSE clipped OR cut END
          FROM (SELECT conv_id, n, left_now, stopped OR left_now <= 0 AS stop, taken, text, clipped, length(shown) > allowed AS cut,
                       CASE WHEN length(shown) <= allowed THEN shown WHEN allowed <= 0 THEN '' WHEN allowed = 1 THEN '…' ELSE regexp_replace(substr(shown, 1, CASE WHEN gap > 0 AND allowed - 1 - gap >= floor(allowed * 0.7) THEN allowed - 1 - gap ELSE allowed - 1 END), '\\s+$', '') || '…' END AS value
                FROM (SELECT f.conv_id, o.n, left_ - CASE WHEN taken > 0 THEN 2 ELSE 0 END AS left_now, stopped, taken, text, clipped, shown, {_ALLOWED} AS allowed, instr(reverse(replace(substr(shown, 1, CAST(greatest(0, {_ALLOWED} - 1) AS BIGINT)), chr(10), ' ')), ' ') AS gap
                      FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1 WHERE o.n <= 5))),
    last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1), c AS (SELECT conv_id, count(*) AS kept FROM o GROUP BY 1)
    SELECT conv_id AS page_id, conv_id AS query_id, text, coalesce(kept, 0) > 5 OR stopped OR clipped AS truncated, clipped AS section_truncated, coalesce(kept, 0) = 0 AS none_relevant FROM last LEFT JOIN c USING (conv_id)
""")
def page_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as pages with a heading per turn; the sections that answer their last turn, within 400 characters."""
    said = F.translate(F.coalesce("text", F.lit("")), "#`~\r\t", "     ")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("heading"), said.alias("x")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("# "), t["heading"], F.lit("\n"), t["x"])), "\n")
    pages = turns.select(F.col("conv_id").alias("page_id"), text.alias("markdown"))
    asked = turns.select(F.col("conv_id").alias("page_id"), F.col("conv_id").alias("query_id"), F.element_at("turns", -1)["x"].alias("query"))
    return vectors.selected(pages, asked, 400, 5).drop("sections")


# --- vectors and evaluation ---------------------------------------------------------------------


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    # Every vector whose id is divisible by 100 is a query, against all vectors.
    return vectors.dense_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, k)


_DENSE = """
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    pair AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS s, a.label = b.label AS good FROM v a, v b WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS position FROM pair)
"""


@query(f"WITH {_DENSE} SELECT query_id, vec_id, round(s, 5) AS similarity, CAST(position AS BIGINT) AS position FROM r WHERE position <= 10")
def dense_search(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 10).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), F.col("position").cast("long"))


@query(f"""
    WITH {_DENSE}, top AS (SELECT * FROM r WHERE position <= 10),
    n AS (SELECT query_id, count(*) FILTER (WHERE good) AS rel FROM pair GROUP BY 1),
    ideal AS (SELECT query_id, sum(1 / log2(i + 1)) AS best FROM n, LATERAL (SELECT unnest(generate_series(1, least(rel, 10))) AS i) GROUP BY 1),
    m AS (SELECT query_id, coalesce(1.0 / min(position) FILTER (WHERE good), 0) AS rr, coalesce(sum(1 / log2(position + 1)) FILTER (WHERE good), 0) AS dcg, count(*) FILTER (WHERE good) AS h10, count(*) FILTER (WHERE good AND position <= 5) AS h5 FROM top GROUP BY 1)
    SELECT count(*) AS queries, round(avg(rr), 4) AS mrr, round(avg(dcg / best), 4) AS ndcg, round(avg(h10 / rel), 4) AS recall, round(avg(h5 / 5.0), 4) AS precision, CAST(0 AS DOUBLE) AS zero_result_rate
    FROM m JOIN n USING (query_id) JOIN ideal USING (query_id)
""")
def dense_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # Relevant are the vectors of the query's label: those of the ten first are looked up, all are only counted.
    top = evaluate.first_ten(_dense(spark, sf, 10), "vec_id").join(asked.withColumnRenamed("label", "wanted"), "query_id").join(e, "vec_id")
    graded = top.select("query_id", "rank", F.when(F.col("label") == F.col("wanted"), 1).alias("grade"))
    totals = asked.join(e.groupBy("label").agg(F.count("*").alias("n")), "label").select("query_id", F.lit(1).alias("grade"), "n")
    return evaluate.summary(evaluate.graded_quality(asked.select("query_id"), graded, totals))


@query(f"""
    WITH {_DENSE}, near AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.label, b.vec_id) AS position FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 100 = 0),
    both_ AS (SELECT query_id, vec_id, position FROM r WHERE position <= 40 UNION ALL SELECT query_id, vec_id, position FROM near WHERE position <= 40),
    f AS (SELECT query_id, vec_id, sum(1.0 / (60 + position)) AS fused FROM both_ GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, vec_id) AS position FROM f)
    SELECT query_id, vec_id, round(fused, 6) AS fused, CAST(position AS BIGINT) AS position FROM k WHERE position <= 10
""")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # The second ranking is that of the label, by id; all queries of a label have the same one, cut to what fusion reads.
    near = e.withColumn("position", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("position") <= vectors.FUSION_DEPTH)
    out = vectors.fused([_dense(spark, sf, 40), asked.join(near, "label").select("query_id", "vec_id", "position")], "vec_id")
    return out.select("query_id", "vec_id", F.round("fused", 6).alias("fused"), F.col("position").cast("long"))


@query()
def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", vectors.hashed_vector(F.col("text")).alias("vector"))


@query("""
    SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS max FROM lineitem GROUP BY 1
""")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.latency_summary(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


# --- catalog ------------------------------------------------------------------------------------


@query("""
    WITH old AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_orderkey, o_custkey, 'P' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%')
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
           round(coalesce(n.o_totalprice, o.o_totalprice), 2) AS o_totalprice, coalesce(o.o_orderdate, n.o_orderdate) AS o_orderdate, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
""")
def snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    new = o.where("o_orderpriority like '1%'").withColumns({"o_orderstatus": F.lit("P"), "o_totalprice": F.col("o_totalprice") + 1})
    return catalog.upserted(o.where("o_orderstatus <> 'P'"), new, ["o_orderkey"], ["o_orderdate"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""
    WITH v AS (SELECT conv_id AS document_id, sha256(coalesce(text, '')) AS h, turn FROM conversations),
    vv AS (SELECT document_id, h, max(turn) AS turn FROM v GROUP BY 1, 2), l AS (SELECT document_id, max(turn) AS m FROM v GROUP BY 1)
    SELECT vv.document_id, h AS content_hash, turn AS last_turn, turn = m AS is_current FROM vv JOIN l ON vv.document_id = l.document_id
""")
def version_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), T.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"), "turn")
    by_hash = seen.groupBy("document_id", "content_hash").agg(F.max("turn").alias("last_turn"))
    now = catalog.latest(seen, ["document_id"], [F.col("turn")]).select("document_id", F.col("turn").alias("m"))
    return by_hash.join(now, "document_id").select("document_id", "content_hash", "last_turn", (F.col("last_turn") == F.col("m")).alias("is_current"))


@query("""
    WITH a AS (SELECT source AS source_key, count(*) AS n, min(lang) AS language FROM documents GROUP BY 1), b AS (SELECT source AS source_key, count(*) AS n, max(lang) AS language FROM documents WHERE length(text) > 10 GROUP BY 1)
    SELECT b.source_key, CASE WHEN a.source_key IS NULL THEN 'created' WHEN a.language = b.language THEN 'skipped' ELSE 'updated' END AS status FROM b LEFT JOIN a USING (source_key)
""")
def source_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    fixed = {c: F.lit("x") for c in catalog.SOURCE_FIELDS if c != "language"}
    old = d.groupBy(F.col("source").alias("source_key")).agg(F.min("lang").alias("language")).withColumns(fixed)
    new = d.where(F.length("text") > 10).groupBy(F.col("source").alias("source_key")).agg(F.max("lang").alias("language")).withColumns(fixed)
    return catalog.reconciled(old, new)


@query("""
    SELECT c.conv_id, c.turn, c.role, length(c.text) AS n FROM conversations c
    WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')
    UNION ALL SELECT conv_id, CAST(-1 AS BIGINT), 'replaced', max(length(text)) FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1
""")
def section_replace(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    hit = c.join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi")
    new = hit.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("replaced").alias("role"), "n")
    return catalog.replaced(c, new, "conv_id")


@query("""
    SELECT user_id AS document_id, event_type AS url, max_by(props, ts) IS NOT NULL AS known, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY 1, 2
""")
def alias_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("url"), F.coalesce("props", F.lit("")).alias("alias_type"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"))
    split = e.agg((F.min("last_seen_at") + (F.max("last_seen_at") - F.min("last_seen_at")) / 2).alias("m"))
    marked = e.join(F.broadcast(split))
    old, new = marked.where("last_seen_at < m").drop("m"), marked.where("last_seen_at >= m").drop("m")
    out = catalog.aliases_upserted(old, new)
    return out.select("document_id", "url", F.col("alias_type").isNotNull().alias("known"), "first_seen_at", "last_seen_at")


# --- retention and paging -----------------------------------------------------------------------


@query("""
    WITH r AS (SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS cur FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM r WHERE NOT cur)
    SELECT conv_id AS document_id, turn AS version_id FROM k WHERE n > 2
""")
def version_retention(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"))
    v = c.join(last, "conv_id").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version_id"), F.col("turn").alias("fetched_at"), (F.col("turn") == F.col("m")).alias("is_current"), F.lit(False).alias("pending_current"))
    return retention.keep_newest_versions(v, 2).select("document_id", "version_id")


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def age_retention(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return retention.within_age(e.join(F.broadcast(e.agg(F.max("ts").alias("now")))), "ts", F.col("now"), 10).select("event_id", "ts", "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 5000")
def count_retention(spark: SparkSession, sf: str) -> DataFrame:
    return retention.newest(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 5000)


_CACHE = "SELECT event_type AS kind, event_id AS cache_key, ts, CAST(abs(value) * 100 AS BIGINT) + 1 AS size_bytes FROM events"


@query(f"""
    WITH c AS ({_CACHE}), r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER () AS n, sum(size_bytes) OVER () AS total, sum(size_bytes) OVER w - size_bytes AS before FROM c WINDOW w AS (ORDER BY ts, kind, cache_key ROWS UNBOUNDED PRECEDING))
    SELECT kind, cache_key, size_bytes FROM r WHERE n - rn + 1 > 4000 OR total - before > 10000000
""")
def lru_eviction(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("cache_key"), F.col("ts").alias("last_accessed_at"), F.col("ts").alias("created_at"), (F.bround(F.abs("value") * 100).cast("long") + 1).alias("size_bytes"))
    return retention.evicted(e, 4000, 10_000_000).select("kind", "cache_key", "size_bytes")


@query(f"WITH c AS ({_CACHE}) SELECT count(*) AS entries, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM c")
def cache_usage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", (F.bround(F.abs("value") * 100).cast("long") + 1).alias("size_bytes"))
    return retention.usage(e.where("event_type < 'm'"), e.where("event_type >= 'm' or event_type is null"))


@query("SELECT c_custkey, c_name, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 20 AS BIGINT) AS page_id FROM customer")
def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    return paging.paged(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("""
    SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) - CAST(l_quantity AS BIGINT) AS before, row_number() OVER w AS rank
    FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) ROWS UNBOUNDED PRECEDING)
""")
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    out = retention.running(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"], F.col("q"))
    return out.select("l_orderkey", "l_linenumber", F.col("before").cast("long"), F.col("rank").cast("long"))


@query("SELECT event_id, event_type, user_id FROM events WHERE instr(lower(event_type), 'c') > 0 AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-31'")
def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.col("event_type").alias("query"), F.col("ts").alias("executed_at"))
    return paging.history_page(h, text="C", start="2024-01-01", end="2024-12-31").select("event_id", "event_type", "user_id")


_REDACTED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
        '(?i)Bearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b', '[REDACTED]', 'g'),
        '\\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16})\\b', '[REDACTED]', 'g'),
        '(?i)(\\b(?:authorization|credential|password|passwd|secret|token|access[-_]?token|refresh[-_]?token|api[-_]?key|signature|sig)\\s*[=:]\\s*)("[^"]*"|''[^'']*''|[^\\s&,;]+)', '\\1[REDACTED]', 'g')"""


@query(f"""
    SELECT doc_id, {_REDACTED} AS query, '{{"token":"[REDACTED]","list":[{{"deep":[[{{"apiKey":"[REDACTED]","n":' || doc_id || '}}]]}},{{"text":' || CAST(to_json({_REDACTED}) AS VARCHAR) || '}}],"inner":{{"password":"[REDACTED]","ok":true}}}}' AS request_json FROM documents
""")
def history_redaction(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    deep = F.struct(F.array(F.array(F.struct(F.struct("lang").alias("apiKey"), F.col("doc_id").alias("n")))).alias("deep"))
    items = F.concat(F.lit("["), F.to_json(deep), F.lit(","), F.to_json(F.struct("text")), F.lit("]"))
    request = F.concat(F.lit(' {"token":'), F.to_json(F.array("lang", "source")), F.lit(',"list":'), items, F.lit(',"inner":'), F.to_json(F.struct(F.col("source").alias("password"), F.lit(True).alias("ok"))), F.lit("}"))
    return redacted_history(d.select("doc_id", F.col("text").alias("query"), request.alias("request_json")))


# --- audits -------------------------------------------------------------------------------------


@query("""
    SELECT 'lineitem_order' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
""")
def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    pairs = [
        ("lineitem_order", t("lineitem").withColumnRenamed("l_orderkey", "k"), t("orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "k")),
        ("order_customer", t("orders").withColumnRenamed("o_custkey", "k"), t("customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "k")),
        ("label_document", t("labels").withColumnRenamed("doc_id", "k"), t("documents").where("lang = 'en'").withColumnRenamed("doc_id", "k")),
    ]
    out = None
    for name, child, parent in pairs:
        part = audit.orphans(child.select("k"), parent.select("k"), ["k"]).agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


_POST = "SELECT doc_id, unnest(tok) AS term, unnest(range(len(tok))) AS pos FROM (SELECT doc_id, {} AS tok FROM documents)"


@query(f"""
    WITH a AS ({_POST.format(_TOKENS.format('text'))}), b AS ({_POST.format(_TOKENS.format("CASE WHEN lang = 'de' THEN replace(text, 'und', 'oder') ELSE text END"))}),
    x AS (SELECT doc_id, term, pos FROM a EXCEPT ALL SELECT doc_id, term, pos FROM b), y AS (SELECT doc_id, term, pos FROM b EXCEPT ALL SELECT doc_id, term, pos FROM a)
    SELECT doc_id AS section_id, 'stored' AS side, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT doc_id, 'fresh', count(*) FROM y GROUP BY 1
""")
def drift_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("section_id"), "lang", F.col("text").alias("content"))
    new = d.withColumn("content", F.when(F.col("lang") == "de", F.replace("content", F.lit("und"), F.lit("oder"))).otherwise(F.col("content")))
    drift = audit.token_drift(sections.tokens_by_field(d, ["content"]), sections.tokens_by_field(new, ["content"]))
    return drift.groupBy("section_id", "side").agg(F.count("*").alias("n"))


_IP = "CAST(event_id % 256 AS VARCHAR) || '.' || CAST((event_id * 7) % 256 AS VARCHAR) || '.' || CAST((event_id * 13) % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR)"


@query(f"""
    WITH e AS (SELECT event_id, {_IP} AS ip, ((event_id % 256) * 16777216 + ((event_id * 7) % 256) * 65536 + ((event_id * 13) % 256) * 256 + user_id % 256) AS n FROM events)
    SELECT event_id, ip, NOT ({' OR '.join(f'n BETWEEN {a} AND {b}' for a, b in audit.blocked_ranges())}) AS public FROM e
""")
def address_audit(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda x: F.pmod(x, F.lit(256)).cast("string")
    e = table(spark, sf, "events").select("event_id", F.concat_ws(".", part(F.col("event_id")), part(F.col("event_id") * 7), part(F.col("event_id") * 13), part(F.col("user_id"))).alias("ip"))
    return e.select("event_id", "ip", audit.public_address(F.col("ip")).alias("public"))


@query("""
    SELECT (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en') AS enabled_sources, (SELECT count(*) FROM documents) AS documents,
           (SELECT count(*) FROM documents WHERE length(text) > 100) AS active_documents, (SELECT count(*) FROM pages) AS current_sections, (SELECT count(DISTINCT doc_id) FROM labels) AS indexed_sections
""")
def summary_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    s = d.groupBy("source").agg(F.bool_or(F.col("lang") == "en").alias("enabled"))
    docs = d.select("doc_id", F.when(F.length("text") > 100, "ACTIVE").otherwise("STALE").alias("status"))
    return audit.catalog_summary(s, docs, table(spark, sf, "pages"), table(spark, sf, "labels").withColumnRenamed("doc_id", "section_id"))


@query("""
    SELECT 'positive_price' AS rule, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)) AS violations FROM orders
    UNION ALL SELECT 'known_status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders
""")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    return audit.violations(table(spark, sf, "orders"), {"positive_price": F.col("o_totalprice") > 1000, "known_status": F.col("o_orderstatus").isin("F", "O")})


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"])


@query("""
    WITH top AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, o_orderkey, CAST(k AS BIGINT) AS k FROM top WHERE k <= 3
""")
def top_per_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", k.cast("long").alias("k")).where("k <= 3")


@query("""
    SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type AS tool, count(*) AS requests, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1, 2
""")
def windowed_history(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.jobs import windowed_activity

    e = table(spark, sf, "events").select(F.col("ts").alias("executed_at"), F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"))
    return windowed_activity(e).withColumn("mean_ms", F.round("mean_ms", 6))


def own_registry(pages: DataFrame) -> DataFrame:
    """A registry entry for every .org host of the pages, in order of the host."""
    host = urls.host(F.col("url"))
    domains = pages.where(host.endswith(".org")).select(host.alias("domain")).distinct()
    return retention.running(domains, ["domain"], F.lit(1)).select(
        F.col("rank").alias("ordinal"), F.col("domain").alias("id"), "domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("base_url"), F.lit("").alias("path_prefix"), F.lit(True).alias("include_subdomains"),
        F.array().cast("array<string>").alias("organizations"), F.lit(100).alias("priority"), F.lit(True).alias("enabled"),
    )


@query()
def web_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as results of one query per host: mapped, matched with a registry made of their own hosts, ranked."""
    pages = extracted(table(spark, sf, "pages"))
    host = urls.host(F.col("url"))
    n = F.row_number().over(Window.partitionBy(host).orderBy("page_id")) - 1
    results = pages.select(F.xxhash64(host).alias("query_id"), F.col("title").alias("query"), n.alias("rank"), "title", "url", F.substring("markdown", 1, 200).alias("snippet"), (F.length("markdown") / 1000).alias("score"), F.array(F.lit("crawl")).alias("engines"))
    return webrank.ranked(webrank.mapped(results, own_registry(table(spark, sf, "pages").select("url"))), 10).drop("engines")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return document_search(spark, sf)
