"""Queries for operators that no other query calls, and their SQL: readers, single functions, catalog views, checks of rows.

Inputs are made from the supplied tables by expressions, so that every branch occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import audit, catalog, retention, search, webrank
from ..sources import readers
from ..sources.readers import table
from .registry import _URLS, query


@query(f"""
    WITH {_URLS}
    SELECT page_id AS query_id, CAST(0 AS INTEGER) AS rank, 'T ' || page_id AS title, url, 'page ' || page_id || ' & A é more' AS snippet, CAST(page_id AS DOUBLE) / 4 AS score, 'crawl' AS engines,
           CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2024-01-0' || (page_id % 9 + 1) || 'T00:00:00.000Z' END AS published_at, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'en-Latn-US' END AS language FROM c
    UNION ALL SELECT page_id, 1, '', url, '', NULL, 'a,b', NULL, NULL FROM c
""")
def provider_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a provider's JSON answers of two results each, the second with next to nothing in it."""
    p = table(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    first = F.struct(
        F.concat(F.lit("T "), n).alias("title"), "url", F.concat(F.lit("<b>page</b>\n "), n, F.lit(" &amp; &#x41; <i>&eacute;</i>  more")).alias("content"), (F.col("page_id") / 4).alias("score"), F.lit("crawl").alias("engine"),
        F.when(F.col("page_id") % 3 == 0, "soon").otherwise(F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"))).alias("publishedDate"), F.when(F.col("page_id") % 5 == 0, "no tag!").otherwise("EN-latn-us").alias("language"),
    )
    second = F.to_json(F.struct("url", F.array(F.lit("a"), F.lit("b")).alias("engines")))
    response = F.concat(F.lit('{"results":['), F.to_json(first), F.lit(","), second, F.lit("]}"))
    found = readers.provider_results(p.select(F.col("page_id").alias("query_id"), "url", response.alias("response"), F.lit("q").alias("query")))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "title", "url", "snippet", "score", F.array_join("engines", ",").alias("engines"), "published_at", "language")


@query("""
    WITH b AS (SELECT event_id, event_id % 6 AS kind, CAST(event_id AS VARCHAR) AS n FROM events)
    SELECT event_id AS page_id, CASE kind WHEN 0 THEN '```json' || chr(10) || '{' || chr(10) || '  "id": ' || n || ',' || chr(10) || '  "tags": [' || chr(10) || '    "a",' || chr(10) || '    {}' || chr(10) || '  ]' || chr(10) || '}' || chr(10) || '```'
           WHEN 1 THEN '```json' || chr(10) || '{"broken": ' || n || chr(10) || '```' WHEN 2 THEN '```xml' || chr(10) || '<n>' || n || '</n>' || chr(10) || '```' WHEN 3 THEN '```yaml' || chr(10) || 'n: ' || n || chr(10) || '```' ELSE 'plain ' || n END AS markdown FROM b WHERE kind <> 5
""")
def crawl_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as crawled resources of six content types."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    kinds = {
        "application/ld+json; charset=utf-8": F.concat(F.lit(' {"id":'), n, F.lit(',"tags":["a",{}]} ')), "application/json": F.concat(F.lit('{"broken": '), n), "Text/XML": F.concat(F.lit("<n>"), n, F.lit("</n>")),
        "application/x-yaml": F.concat(F.lit("n: "), n), "text/plain": F.concat(F.lit("plain "), n), "application/pdf": n,
    }
    made = F.array(*[F.struct(F.lit(kind).alias("content_type"), body.alias("body")) for kind, body in kinds.items()])
    rows = table(spark, sf, "events").select(e.alias("page_id"), F.lit("https://e.com/").alias("url"), F.element_at(made, (e % 6 + 1).cast("int")).alias("r"))
    return readers.crawled(rows.select("page_id", "url", "r.*")).select("page_id", "markdown")


@query("""
    WITH h AS (SELECT doc_id, text, substr(text, 1, 199) AS h FROM documents), l AS (SELECT *, length(h) - instr(reverse(replace(h, chr(10), ' ')), ' ') AS last, instr(replace(h, chr(10), ' '), ' ') > 0 AS any_ FROM h)
    SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(substr(h, 1, CASE WHEN any_ AND last >= 140 THEN last ELSE length(h) END), '\\s+$', '') || '…' ELSE text END AS cut,
           sha256('{"query":"' || lower(source || ' Q') || '","allow":["' || least(lang, source) || '","' || greatest(lang, source) || '"],"deny":[]}') AS fingerprint FROM l JOIN (SELECT doc_id AS d, lang, source FROM documents) ON d = doc_id
""")
def cut_and_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    mark = T.request_fingerprint(F.concat("source", F.lit(" Q")), F.array("source", "lang"), F.array().cast("array<string>"))
    return d.select("doc_id", T.cut_at_boundary(F.col("text"), 200).alias("cut"), mark.alias("fingerprint"))


@query(f"""
    WITH {_URLS}
    SELECT page_id, canonical AS links, CASE WHEN page_id % 4 = 0 THEN 'deep ' || page_id WHEN page_id % 4 = 1 THEN 'flat' END AS told, page_id % 4 = 0 AND page_id % 3 <> 0 AS conditional, CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 28 + 1 AS VARCHAR) END AS day FROM c
""")
def rule_facts(spark: SparkSession, sf: str) -> DataFrame:
    p, n = table(spark, sf, "pages"), F.col("page_id")
    text = F.concat(F.lit("see "), F.col("url"), F.lit(", or ("), F.col("url"), F.lit(")! and <https://user@bad.example/>"))
    told = F.when(n % 4 == 0, F.concat(F.lit('{"a":{"b":"deep '), n.cast("string"), F.lit('"},"c":"flat"}'))).when(n % 4 == 1, '{"c":"flat"}').when(n % 4 == 2, "{no json").otherwise('{"d":1}')
    etag = F.when(n % 3 == 0, "bad\r\nheader").otherwise("e")
    at = F.when(n % 2 == 0, F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).otherwise("2024-13-45")
    return p.select(
        "page_id", F.array_join(rules.plain_links(text), " ").alias("links"), rules.json_text(told, "$.a.b", "$.c").alias("told"),
        rules.conditional_allowed(F.col("url"), F.when(n % 4 == 0, F.col("url")).otherwise("https://other.example/"), etag, F.lit(None).cast("string")).alias("conditional"),
        F.day(F.substring(rules.parsed_date(at), 1, 10).cast("date")).cast("string").alias("day"),
    )


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as documents of two versions each, their orders as sections, nations as sources."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    documents = c.select(k.alias("document_id"), F.col("c_nationkey").cast("string").alias("source_key"), F.col("c_name").alias("title"), F.lit("en").alias("language"), F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("STALE").alias("status"), (k * 2 + F.when(k % 5 == 0, 0).otherwise(1)).alias("current_version_id"))
    versions = c.select(k.alias("document_id"), F.explode(F.array(k * 2, k * 2 + 1)).alias("version_id")).withColumn("is_current", F.col("version_id") % 2 == F.when(F.col("document_id") % 7 == 0, 0).otherwise(1))
    held = table(spark, sf, "orders").select(F.col("o_orderkey").alias("section_id"), (F.col("o_custkey") * 2 + F.col("o_orderkey") % 2).alias("version_id"), F.col("o_orderkey").alias("ordinal"))
    sources = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("source_key"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    return held, versions, documents, sources


@query("""
    SELECT o_orderkey AS section_id, c_custkey AS document_id, CAST(c_nationkey AS VARCHAR) AS source_key FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_acctbal > 0 AND c_nationkey % 3 <> 0 AND o_orderkey % 2 = CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AND o_orderkey % 2 = CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END
""")
def searchable_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the version that the flag and the pointer agree on, of active documents of enabled sources."""
    return catalog.searchable(catalog.current_sections(*_catalog(spark, sf))).select("section_id", "document_id", "source_key")


@query("""
    WITH o AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 99 ELSE n_regionkey END AS r FROM nation WHERE n_nationkey < 20)
    SELECT c_custkey AS document_id FROM customer JOIN o ON c_nationkey = o.k JOIN n USING (k) WHERE o.r <> n.r
""")
def moved_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of sources whose attributes changed."""
    fixed = {c: F.lit("x") for c in catalog.SOURCE_FIELDS if c != "language"}
    source = lambda r: table(spark, sf, "nation").select(F.col("n_nationkey").alias("source_key"), "n_nationkey", r.cast("string").alias("language")).withColumns(fixed)
    new = source(F.when(F.col("n_nationkey") % 4 == 0, 99).otherwise(F.col("n_regionkey"))).where("n_nationkey < 20")
    documents = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("source_key"))
    return catalog.changed_source_documents(source(F.col("n_regionkey")), new, documents).select("document_id")


@query("""
    WITH e AS (SELECT event_id, event_id % 5 AS kind, CAST(event_id AS VARCHAR) AS n FROM events)
    SELECT event_id, n AS details FROM e WHERE kind < 2
""")
def well_formed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose details are a JSON object; others hold arrays, texts or broken JSON."""
    n = F.col("event_id").cast("string")
    made = F.array(F.concat(F.lit('{"n":"'), n, F.lit('"}')), F.concat(F.lit(' {"n":"'), n, F.lit('","m":[{}]} ')), F.concat(F.lit('["'), n, F.lit('"]')), F.concat(F.lit('{"n":"'), n, F.lit('"')), n)
    rows = table(spark, sf, "events").select("event_id", F.element_at(made, (F.col("event_id") % 5 + 1).cast("int")).alias("details_json"))
    return catalog.valid_events(rows).select("event_id", F.get_json_object("details_json", "$.n").alias("details"))


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 3 THEN 'NOT_HTTPS' WHEN p_partkey % 10 = 5 THEN 'OUTSIDE_DOMAIN' ELSE 'OUTSIDE_PATH' END AS error FROM part WHERE p_partkey % 10 IN (3, 5, 7)
    UNION ALL SELECT -1 AS id, 'DUPLICATE_ID' WHERE (SELECT count(*) FROM part WHERE p_partkey % 10 = 9) > 1
""")
def registry_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as registry entries: some not https, outside their domain or path, and some that share an id."""
    k = F.col("p_partkey")
    host = F.concat(F.lit("p"), k.cast("string"), F.lit(".example.org"))
    scheme, at = F.when(k % 10 == 3, "http://").otherwise("https://"), F.when(k % 10 == 7, "/other").otherwise("/docs/a")
    rows = table(spark, sf, "part").select(F.when(k % 10 == 9, -1).otherwise(k).cast("long").alias("id"), F.when(k % 10 == 5, "example.com").otherwise("Example.org").alias("domain"), F.concat(scheme, host, at).alias("base_url"), F.when(k % 2 == 1, "/docs").alias("path_prefix"))
    return audit.registry_errors(rows)


@query("""
    SELECT o_orderkey AS k, o_orderkey % 4 IN (0, 2) AND o_orderkey % 4 <> 2 AS valid FROM orders
""")
def cached_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cached result pages; one in four is whole, others have a wrong count, a score out of range, or no safe URL."""
    k = F.col("o_orderkey")
    result = F.struct(F.lit("t").alias("title"), F.when(k % 4 == 3, "javascript:x").otherwise("https://e.com/a").alias("url"), F.when(k % 4 == 2, 1.5).otherwise(0.5).alias("score"))
    payload = F.to_json(F.struct(F.when(k % 4 == 1, 2).otherwise(1).alias("returned"), F.array(result).alias("results")))
    return table(spark, sf, "orders").select(k.alias("k"), audit.cached_payload_valid(payload).alias("valid"))


@query("""
    WITH q AS (SELECT DISTINCT source, lang FROM documents)
    SELECT source || '-' || lang AS query_id, n_nationkey AS id FROM q, nation WHERE n_nationkey % 5 <> 0 AND contains(lower('About ' || source || ' in ' || lang), ['en', 'ABOUT WEB', 'fr', 'de'][n_nationkey % 4 + 1].lower())
""")
def keyword_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Entries any keyword of which stands in a query."""
    asked = table(spark, sf, "documents").select("source", "lang").distinct().select(F.concat_ws("-", "source", "lang").alias("query_id"), F.concat(F.lit("About "), "source", F.lit(" in "), "lang").alias("query"))
    entries = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5 != 0).alias("enabled"), F.lit(1).alias("priority"), F.array(F.element_at(F.array(*map(F.lit, ["en", "ABOUT WEB", "fr", "de"])), (F.col("n_nationkey") % 4 + 1).cast("int")), F.lit("no such word")).alias("keywords"))
    return webrank.keyword_routes(asked, entries).select("query_id", "id")


@query("""
    WITH a AS (SELECT event_id AS k, length(event_type) AS n FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id AS k FROM events WHERE event_id % 2 = 0)
    SELECT coalesce(a.k, b.k) AS cache_key, CASE WHEN b.k IS NOT NULL THEN 4 ELSE n END AS size_bytes, CASE WHEN b.k IS NOT NULL THEN TIMESTAMP '2024-03-01 01:00:00' ELSE TIMESTAMP '2024-02-01' END AS expires_at FROM a FULL JOIN b ON a.k = b.k
""")
def cache_writes(spark: SparkSession, sf: str) -> DataFrame:
    """A cache after entries were put: new and known keys, sizes in UTF-8 bytes, expiry from the time of writing."""
    e, at = table(spark, sf, "events"), F.lit("2024-01-01").cast("timestamp")
    old = e.where("event_id % 3 <> 0").select(F.lit("k").alias("kind"), F.col("event_id").alias("cache_key"), F.col("event_type").alias("payload"), F.length("event_type").cast("long").alias("size_bytes"), at.alias("created_at"), at.alias("last_accessed_at"), F.lit("2024-02-01").cast("timestamp").alias("expires_at"))
    new = e.where("event_id % 2 = 0").select(F.lit("k").alias("kind"), F.col("event_id").alias("cache_key"), F.lit("éé").alias("payload"))
    return retention.cache_put(old, new, F.lit("2024-03-01").cast("timestamp"), F.lit(3600)).select("cache_key", "size_bytes", "expires_at")


@query("""
    WITH q AS (SELECT c_custkey AS query_id, c_custkey % 3 AS p, c_custkey % 7 = 0 AS degraded, 3 + c_custkey % 4 AS found FROM customer),
    r AS (SELECT o_custkey AS query_id, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS official, bool_or(o_orderkey % 11 = 0) AS fell, count(*) FILTER (WHERE o_orderkey % 13 = 0) AS undated FROM orders GROUP BY 1),
    j AS (SELECT q.*, coalesce(n, 0) AS n, coalesce(official, 0) AS official, coalesce(fell, false) AS fell, coalesce(undated, 0) AS undated FROM q LEFT JOIN r USING (query_id)),
    w AS (SELECT query_id, n, list_filter([CASE WHEN n = 0 THEN 'NO_RESULTS' END, CASE WHEN n > 0 AND official = 0 THEN 'NO_VERIFIED_OFFICIAL_SOURCE' END, CASE WHEN p = 1 AND official > 0 AND official < n THEN 'NON_OFFICIAL_RESULTS_INCLUDED' END,
          CASE WHEN found > 5 THEN 'RESULTS_TRUNCATED' END, CASE WHEN undated > 0 THEN 'DATE_UNAVAILABLE' END, CASE WHEN degraded THEN 'PARTIAL_FAILURE' END, CASE WHEN fell THEN 'FALLBACK' END], lambda x: x IS NOT NULL) AS warnings FROM j)
    SELECT query_id, n AS n_results, array_to_string(warnings, ',') AS warnings, CASE WHEN list_has_any(warnings, ['NO_RESULTS', 'PARTIAL_FAILURE', 'FALLBACK', 'RESULTS_TRUNCATED']) THEN 'partial' ELSE 'complete' END AS status FROM w
""")
def search_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as queries, their orders as results: warnings and status of each."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    queries = table(spark, sf, "customer").select(k.alias("query_id"), F.element_at(F.array(F.lit("any"), F.lit("prefer"), F.lit("strict")), (k % 3 + 1).cast("int")).alias("policy"), F.lit(5).alias("wanted"), (k % 7 == 0).alias("degraded"), (k % 4 + 3).alias("found"))
    results = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.when(o % 2 == 0, "VERIFIED_OFFICIAL").otherwise("UNKNOWN").alias("source_status"), F.when(o % 13 != 0, "2024").alias("published_at"), (o % 11 == 0).alias("fell_back"))
    return search.result_warnings(queries, results).select("query_id", "n_results", F.array_join("warnings", ",").alias("warnings"), "status")


@query("""
    WITH d AS (SELECT o_orderkey AS k, o_orderkey % 6 AS kind FROM orders)
    SELECT k, CASE kind WHEN 1 THEN 'TITLE_INVALID' WHEN 2 THEN 'STABLE_KEY_INVALID' WHEN 3 THEN 'URL_INVALID' WHEN 4 THEN 'LANGUAGE_TAG_INVALID,MIME_TYPE_INVALID' ELSE '' END AS errors FROM d
""")
def descriptor_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as document descriptors, accepted ones without errors beside rejected ones with theirs."""
    k = F.col("o_orderkey")
    kind = k % 6
    rows = table(spark, sf, "orders").select(
        k.alias("k"), F.when(kind == 1, "  ").otherwise("A title").alias("title"), F.when(kind == 2, "a\x00b").otherwise(k.cast("string")).alias("stable_key"), F.when(kind == 3, "ftp://e.com/").otherwise("https://e.com/a").alias("url"),
        F.when(kind == 4, "no tag!").otherwise("en").alias("language"), F.when(kind == 4, "text").otherwise("text/html").alias("mime_type"),
    )
    good, bad = audit.accepted_rejected(rows, audit.document_errors())
    return good.select("k", F.lit("").alias("errors")).unionByName(bad.select("k", F.array_join("errors", ",").alias("errors")))


@query("""
    WITH d AS (SELECT c_custkey AS k, c_custkey % 4 AS kind FROM customer) SELECT k, CASE kind WHEN 1 THEN 'SOURCE_KEY_INVALID' WHEN 2 THEN 'BASE_URL_INVALID,SOURCE_TYPE_INVALID' WHEN 3 THEN 'DISPLAY_NAME_INVALID' END AS errors FROM d WHERE kind <> 0
""")
def source_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as source descriptors that are rejected, and why."""
    k = F.col("c_custkey")
    kind = k % 4
    rows = table(spark, sf, "customer").select(
        k.alias("k"), F.when(kind == 1, "Upper Case").otherwise(F.concat(F.lit("source-"), k.cast("string"))).alias("source_key"), F.when(kind == 3, "").otherwise(F.col("c_name")).alias("display_name"),
        F.when(kind == 2, "nothing").otherwise("https://e.com/").alias("base_url"), F.when(kind == 2, "shop").otherwise("blog").alias("source_type"), F.lit("de").alias("language"),
    )
    return audit.accepted_rejected(rows, audit.source_errors())[1].select("k", F.array_join("errors", ",").alias("errors"))


@query("""
    SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'https://e.com/new' ELSE 'https://e.com/old' END AS final_url, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a' END AS etag,
           CASE WHEN c_custkey % 2 = 0 THEN 'kept=1,seen=2' ELSE 'kept=1,seen=1' END AS metadata FROM customer
""")
def merged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Cached pages, half of them answered with 304: address, validators and metadata of the answer win, what it does not say stays."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    url = F.concat(F.lit("https://e.com/"), k.cast("string"))
    pair = lambda *kv: F.create_map(*map(F.lit, kv))
    cached = c.select(k.alias("k"), url.alias("url"), F.lit("https://e.com/old").alias("final_url"), F.lit("a").alias("etag"), F.lit("m").alias("last_modified"), pair("kept", "1", "seen", "1").alias("metadata"))
    answers = c.where(k % 2 == 0).select(url.alias("url"), F.lit("https://e.com/new").alias("final_url"), F.lit("b").alias("etag"), F.lit(None).cast("string").alias("last_modified"), pair("seen", "2").alias("metadata"))
    merged = catalog.merged_not_modified(cached, answers)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return merged.select("k", "final_url", "etag", shown.alias("metadata"))
