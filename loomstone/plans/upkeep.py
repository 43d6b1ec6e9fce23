"""More queries over whole tables, and their SQL: address and text functions, pages of results, catalog upkeep, audits.

As in the registry, supplied tables stand in for catalog tables; each query calls the operator that it is named after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions import text as T
from ..operators import audit, catalog, evaluate, paging, retention, sections, vectors, webrank
from ..sources.readers import lookup, table
from .registry import _DENSE, _FNV, _IP, _STEM, _TOKENS, _URLS, _dense, own_registry, query

# --- functions ----------------------------------------------------------------------------------


@query(f"""
    WITH {_URLS}, r AS (SELECT page_id, scheme, host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, ask FROM c JOIN (SELECT page_id, ask FROM u) USING (page_id) JOIN (SELECT page_id AS p FROM u) ON p = page_id)
    SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN ask = '' THEN '' ELSE '?' || ask END AS transport, coalesce(nullif(regexp_replace(path, '^/+|/+$', '', 'g'), ''), 'index') AS stable_key,
           CASE WHEN regexp_matches(lower(path), '/readme(?:\\.[a-z0-9]+)?$') THEN 'readme' WHEN ends_with(lower(path), '/sitemap.xml') THEN 'sitemap' ELSE 'documentation' END AS ttl,
           CASE WHEN starts_with(host, 'docs.') OR list_has_any(string_split(lower(path), '/'), ['docs', 'documentation', 'reference']) THEN 'LIKELY_OFFICIAL' ELSE 'UNKNOWN' END AS page_class,
           len(string_split(host, '.')) AS suffixes, host = 'example.org' OR ends_with(host, '.example.org') AS of_example FROM r
""")
def url_facts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.transport_url(u).alias("transport"), T.stable_key(u).alias("stable_key"), rules.ttl_class(u).alias("ttl"), rules.page_trust_class(u, F.lit(False)).alias("page_class"),
        F.size(urls.host_suffixes(urls.host(u))).cast("long").alias("suffixes"), urls.domain_matches(urls.host(u), F.lit("example.org")).alias("of_example"),
    )


_HEAD = "substr(text, 1, 200)"


@query(f"""
    SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(substr(text, 1, 60))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug,
           CASE WHEN NOT regexp_matches({_HEAD}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]') AND length(trim(regexp_replace({_HEAD}, '\\s+', ' ', 'g'))) BETWEEN 2 AND 500 THEN trim(regexp_replace({_HEAD}, '\\s+', ' ', 'g')) END AS asked,
           len(list_distinct(list_filter({_TOKENS.format('text')}, lambda t: length(t) >= 2))) AS terms,
           sha256(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS normal
    FROM documents
""")
def text_facts(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.slug(F.substring(x, 1, 60)).alias("slug"), rules.search_query(F.substring(x, 1, 200)).alias("asked"), F.size(T.distinct_terms(x)).cast("long").alias("terms"), T.sha256(T.normal_markdown(x)).alias("normal"),
    )


_STATUS = [200, 204, 301, 302, 304, 404, 408, 410, 429, 500, 503, 400]


@query(f"""
    WITH e AS (SELECT event_id, ts, value, {_STATUS}[CAST(event_id % 12 AS INT) + 1] AS s FROM events)
    SELECT event_id, CASE WHEN s = 304 THEN 'not_modified' WHEN s IN (404, 410) THEN 'missing' WHEN s IN (301, 308) THEN 'permanent_redirect' WHEN s BETWEEN 300 AND 399 THEN 'redirect'
           WHEN s IN (408, 425, 429) OR s >= 500 THEN 'transient' WHEN s BETWEEN 200 AND 299 THEN 'ok' ELSE 'error' END AS class,
           CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'fresh' WHEN ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20' THEN 'stale' ELSE 'expired' END AS freshness, round(greatest(0.0, least(1.0, value / 100)), 6) AS score
    FROM e
""")
def status_classes(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 12 + 1).cast("int"))
    now = F.lit("2024-01-20").cast("timestamp")
    return table(spark, sf, "events").select("event_id", rules.http_class(status).alias("class"), rules.freshness(F.col("ts"), now, "10 DAYS").alias("freshness"), rules.clamp_score(F.col("value") / 100).alias("score"))


@query(f"""
    WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({T.STOP_WORDS}, x)) AS ts FROM benchmark),
    f AS (SELECT item_id, unnest(ts) AS f, 1.0 AS w FROM t UNION ALL SELECT item_id, {_STEM}, 0.6 FROM (SELECT item_id, unnest(ts) AS t FROM t)
          UNION ALL SELECT item_id, ts[i] || ' ' || ts[i + 1], 0.75 FROM (SELECT item_id, ts, unnest(range(1, len(ts))) AS i FROM t)),
    h AS (SELECT item_id, w, {_FNV.format('f')} AS h FROM f),
    p AS (SELECT item_id, h % 64 AS place, sum(CASE WHEN h % 2 = 0 THEN w ELSE -w END) AS v FROM h GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM p GROUP BY 1)
    SELECT item_id, CAST(place AS BIGINT) AS place, round(CAST(v AS DOUBLE) / norm, 5) AS v FROM p JOIN n USING (item_id) WHERE abs(CAST(v AS DOUBLE)) > 1e-9
""")
def hashed_vector_entries(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "benchmark").select("item_id", F.posexplode(vectors.hashed_vector(F.col("text"))).alias("place", "v"))
    return made.where(F.abs("v") > 1e-9).select("item_id", F.col("place").cast("long"), F.round("v", 5).alias("v"))


# --- results ------------------------------------------------------------------------------------


@query(f"""
    WITH {_URLS}, d AS (SELECT page_id, page_id % 3 AS query_id, host FROM c)
    SELECT page_id, query_id, host AS domain FROM d WHERE NOT (query_id = 0 AND (host = 'org' OR ends_with(host, '.org'))) AND NOT (query_id = 1 AND (host = 'net' OR ends_with(host, '.net')))
           AND (query_id <> 1 OR host IN ('org', 'com') OR ends_with(host, '.org') OR ends_with(host, '.com'))
""")
def domain_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3).alias("query_id"), urls.host(F.col("url")).alias("domain"))
    allow = spark.createDataFrame([(1, "org"), (1, "COM")], "query_id long, domain string")
    deny = spark.createDataFrame([(0, "org"), (1, "net")], "query_id long, domain string")
    return webrank.domain_filtered(rows, allow, deny, ["page_id", "query_id"]).select("page_id", "query_id", "domain")


@query(f"""
    WITH {_URLS}, parts AS (SELECT page_id, list_concat(string_split(host, '.'), string_split(lower(path), '/')) AS p FROM c)
    SELECT page_id FROM parts WHERE page_id % 3 <> 0 OR (NOT list_has_any(p, ['blog', 'community', 'forum']) AND list_has_any(p, ['api', 'developer', 'developers', 'docs', 'documentation', 'learn', 'reference', 'support']))
""")
def source_policies(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(rules.trust_class(F.col("url"), F.lit(False)) == "LIKELY_OFFICIAL", "VERIFIED_OFFICIAL").otherwise("UNKNOWN")
    rows = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3).alias("query_id"), status.alias("source_status"))
    return webrank.policy_filtered(rows, spark.createDataFrame([(0, "strict"), (1, "prefer")], "query_id long, policy string")).select("page_id")


@query(f"""
    WITH {_URLS}, r AS (SELECT DISTINCT host AS domain FROM c WHERE ends_with(host, '.org')), p AS (SELECT page_id, host FROM c WHERE scheme = 'https')
    SELECT c.page_id, m.source_id FROM c LEFT JOIN (SELECT page_id, min(domain) AS source_id FROM p JOIN r ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1) m USING (page_id)
""")
def registry_matches(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return webrank.registry_match(pages, own_registry(pages), ["page_id"]).select("page_id", "source_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 20")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return paging.offset_page(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 20, 80)


@query("""
    WITH p AS (SELECT event_id, user_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 20)
    SELECT event_id, user_id, (SELECT min(event_id) FROM p HAVING (SELECT count(*) FROM events WHERE event_id < 500) > 20) AS next_before, (SELECT count(*) FROM events) AS total FROM p
""")
def key_page(spark: SparkSession, sf: str) -> DataFrame:
    return paging.key_page(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 500, 20)


@query("""
    WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id DESC) AS k, count(*) OVER () AS total FROM events), p AS (SELECT *, (k - 1) // 70 AS page FROM r)
    SELECT event_id, user_id, CAST(page AS BIGINT) AS page, CASE WHEN (page + 1) * 70 < total THEN min(event_id) OVER (PARTITION BY page) END AS next_before, total FROM p
""")
def key_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with the page it is on, and the key that the next page goes on from."""
    return paging.key_pages(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 70)


@query("""
    WITH s AS (SELECT o_custkey, o_orderkey, length('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}') + 1 AS n FROM orders),
    r AS (SELECT o_custkey, o_orderkey, sum(n) OVER w AS used, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey, CAST(used AS BIGINT) AS used, used > 200 AS too_long FROM r WHERE used <= 200 OR k = 1
""")
def budgeted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return paging.within_budget(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 200)


@query("""
    WITH i AS (SELECT doc_id AS section_id FROM documents UNION ALL SELECT -doc_id - 1 FROM labels)
    SELECT section_id, text IS NOT NULL AS found, CASE WHEN length(text) > 300 THEN rtrim(substr(text, 1, 299), chr(32) || chr(10)) || '…' ELSE coalesce(text, '') END AS content, coalesce(length(text) > 300, false) AS truncated
    FROM i LEFT JOIN documents ON doc_id = section_id
""")
def section_reads(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ids = d.select(F.col("doc_id").alias("section_id")).unionByName(table(spark, sf, "labels").select((-F.col("doc_id") - 1).alias("section_id")))
    return paging.read_sections(ids, d.select(F.col("doc_id").alias("section_id"), F.col("text").alias("content")), 300)


@query("""
    WITH t AS (SELECT conv_id, turn, role, translate(coalesce(text, ''), '#`~' || chr(13) || chr(9), '     ') AS x FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, x) - 1 AS ordinal FROM t),
    s AS (SELECT conv_id, ordinal, role || ' ' || turn AS heading, regexp_replace('# ' || role || ' ' || turn || chr(10) || x, '\\s+$', '') AS content FROM k)
    SELECT conv_id AS doc_id, CAST(ordinal AS BIGINT) AS ordinal, heading, heading AS heading_path, length(content) AS character_count, sha256(content) AS content_hash, len(regexp_extract_all(content, '\\S+')) AS token_count FROM s
""")
def ingested_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as Markdown documents with a heading per turn, cut into sections again."""
    said = F.translate(F.coalesce("text", F.lit("")), "#`~\r\t", "     ")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("x")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("# "), t["role"], F.lit(" "), t["turn"].cast("string"), F.lit("\n"), t["x"])), "\n")
    found = sections.sections(turns.select(F.col("conv_id").alias("doc_id"), F.lit("a conversation").alias("title"), text.alias("text")))
    return found.select("doc_id", F.col("ordinal").cast("long"), "heading", "heading_path", F.col("character_count").cast("long"), "content_hash", F.col("token_count").cast("long"))


# --- catalog ------------------------------------------------------------------------------------

_HTTP = [200, 200, 304, 404, 410, 503, 301, 200, 418]
_LOG = f"""
    log AS (SELECT event_id, event_type AS source_key, CAST(user_id AS VARCHAR) AS stable_key, {_HTTP}[CAST(event_id % 9 AS INT) + 1] AS http, CASE WHEN event_id % 11 = 0 THEN 'REQUEST_TIMEOUT' END AS err, CAST(event_id % 3 AS VARCHAR) AS hash, event_id % 7 AS run_id, user_id FROM events),
    kind AS (SELECT *, user_id % 2 = 0 AS known, CAST(user_id % 3 AS VARCHAR) AS old_hash, CASE WHEN http = 304 THEN 'not_modified' WHEN http IN (404, 410) THEN 'missing' WHEN http = 301 THEN 'permanent_redirect' WHEN http >= 500 THEN 'transient' WHEN http = 200 THEN 'ok' ELSE 'error' END AS kind FROM log WHERE user_id % 5 <> 0),
    o AS (SELECT *, CASE WHEN source_key = 'view' THEN 'skipped:SOURCE_DISABLED' WHEN source_key > 's' THEN 'skipped:SOURCE_NOT_FOUND' WHEN known AND kind = 'missing' THEN 'updated' WHEN err IS NOT NULL OR kind IN ('missing', 'transient', 'error') THEN 'failed'
                 WHEN NOT known THEN 'added' WHEN kind = 'not_modified' OR old_hash = hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM kind)
"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a crawl log of their users' documents; half of the users are known documents."""
    e = table(spark, sf, "events")
    rows = e.select("event_type", "user_id").distinct().select(F.col("event_type").alias("source_key"), F.col("user_id").cast("string").alias("stable_key"), "user_id")
    manifest = rows.where("user_id % 5 <> 0")
    sources = e.select(F.col("event_type").alias("source_key")).distinct().where("source_key <= 's' or source_key = 'view'").withColumn("enabled", F.col("source_key") != "view")
    hash_of = lambda c: (F.col(c) % 3).cast("string")
    documents = rows.where("user_id % 2 = 0").select("source_key", "stable_key", F.concat_ws(":", "source_key", "stable_key").alias("document_id"), F.lit("ACTIVE").alias("status"), hash_of("user_id").alias("content_hash"), F.lit("https://a.org/").alias("canonical_url"))
    log = e.select(
        "event_id", F.col("event_type").alias("source_key"), F.col("user_id").cast("string").alias("stable_key"), F.element_at(F.array(*map(F.lit, _HTTP)), (F.col("event_id") % 9 + 1).cast("int")).alias("http_status"),
        F.when(F.col("event_id") % 11 == 0, "REQUEST_TIMEOUT").alias("error_code"), hash_of("event_id").alias("content_hash"), (F.col("event_id") % 7).alias("run_id"), F.col("ts").alias("fetched_at"), F.lit(None).cast("string").alias("canonical_url"),
        F.lit(None).cast("array<struct<from_url: string, to_url: string, status: int, permanent: boolean>>").alias("redirects"),
    )
    return catalog.outcomes(manifest, log, sources, documents)


@query(f"WITH {_LOG} SELECT event_id, outcome, CASE WHEN http = 404 THEN 'STALE' WHEN http = 410 THEN 'REMOVED' WHEN outcome = 'failed' THEN CASE WHEN known THEN 'ACTIVE' END ELSE 'ACTIVE' END AS new_status FROM o")
def observation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select("event_id", "outcome", "new_status")


@query(f"""
    WITH {_LOG}, l AS (SELECT * FROM o WHERE NOT starts_with(outcome, 'skipped'))
    SELECT run_id, 'CONTENT_HASH_CHANGED' AS event_type, count(*) AS n FROM l WHERE known AND outcome = 'updated' AND hash <> old_hash GROUP BY 1 UNION ALL SELECT run_id, 'HTTP_' || http, count(*) FROM l WHERE known AND http IN (404, 410) GROUP BY 1, 2
    UNION ALL SELECT run_id, 'SOURCE_UNAVAILABLE', count(*) FROM l WHERE known AND (kind = 'transient' OR err IS NOT NULL) GROUP BY 1
""")
def observation_events(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.valid_events(catalog.events(_outcomes(spark, sf))).groupBy("run_id", "event_type").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_LOG}, c AS (SELECT run_id, count(*) FILTER (WHERE NOT starts_with(outcome, 'skipped')) AS checked, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged,
    count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o GROUP BY 1) SELECT *, CASE WHEN failed = 0 THEN 'SUCCESS' WHEN failed = checked THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM c
""")
def run_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.run_status(_outcomes(spark, sf))


@query("""
    WITH m AS (SELECT c_nationkey AS source_key, c_nationkey % 4 <> 0 AS enabled, count(*) AS configured FROM customer GROUP BY 1), n AS (SELECT s_nationkey AS source_key, count(*) AS current FROM supplier GROUP BY 1)
    SELECT source_key, configured, coalesce(current, 0) AS current, CASE WHEN enabled THEN configured ELSE 0 END AS planned, CASE WHEN enabled THEN 0 ELSE configured END AS skipped, CASE WHEN NOT enabled THEN 'DISABLED' END AS reason FROM m LEFT JOIN n USING (source_key)
""")
def sync_plans(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source_key"), (F.col("c_nationkey") % 4 != 0).alias("enabled"))
    return catalog.sync_plan(manifest, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source_key")))


@query("""
    WITH m AS (SELECT c_nationkey AS source_key, c_custkey AS stable_key, c_custkey % 9 <> 0 AS enabled FROM customer), s AS (SELECT n_nationkey AS source_key, n_nationkey % 4 <> 0 AS on_ FROM nation WHERE n_nationkey < 22)
    SELECT source_key, stable_key, enabled, CASE WHEN on_ IS NOT NULL AND on_ AND enabled THEN 'planned' ELSE 'skipped' END AS status,
           CASE WHEN on_ IS NULL THEN 'SOURCE_NOT_FOUND' WHEN NOT on_ OR NOT enabled THEN 'DISABLED' END AS reason FROM m LEFT JOIN s USING (source_key)
""")
def document_plans(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source_key"), F.col("c_custkey").alias("stable_key"), (F.col("c_custkey") % 9 != 0).alias("enabled"))
    sources = table(spark, sf, "nation").where("n_nationkey < 22").select(F.col("n_nationkey").alias("source_key"), (F.col("n_nationkey") % 4 != 0).alias("enabled"))
    return catalog.document_plan(manifest, sources)


@query("""
    WITH r AS (SELECT c_nationkey AS source_key, c_custkey AS stable_key FROM customer WHERE c_nationkey % 4 <> 0), spot AS (SELECT c_nationkey AS s, c_custkey AS k FROM customer WHERE c_custkey = 10),
    left_ AS (SELECT source_key, stable_key FROM r, spot WHERE source_key > s OR (source_key = s AND stable_key > k)), p AS (SELECT * FROM left_ ORDER BY 1, 2 LIMIT 40), last AS (SELECT * FROM p ORDER BY 1 DESC, 2 DESC LIMIT 1)
    SELECT source_key, stable_key, (SELECT source_key FROM last WHERE (SELECT count(*) FROM left_) > 40) AS next_source, (SELECT stable_key FROM last WHERE (SELECT count(*) FROM left_) > 40) AS next_key FROM p
""")
def next_slice(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    manifest = c.select(F.col("c_nationkey").alias("source_ord"), F.col("c_custkey").alias("document_ord"), F.col("c_nationkey").alias("source_key"), F.col("c_custkey").alias("stable_key"), (F.col("c_nationkey") % 4 != 0).alias("enabled"))
    nation = c.where("c_custkey = 10").select("c_nationkey").first()
    found = catalog.execution_slice(manifest, after=(nation[0], 10), limit=40, fingerprint=catalog.manifest_fingerprint(manifest))
    return found.select("source_key", "stable_key", "next_source", "next_key")


_VERSIONS = """
    t AS (SELECT conv_id AS document_id, turn, sha256(coalesce(text, '')) AS h, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * turn AS f FROM conversations), last AS (SELECT document_id, max(turn) AS m FROM t GROUP BY 1),
    old AS (SELECT document_id, h, f FROM t JOIN (SELECT document_id, min(turn) AS m0 FROM t GROUP BY 1) USING (document_id) WHERE turn = m0), new AS (SELECT document_id, h, f FROM t JOIN last USING (document_id) WHERE turn = m)
"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "conversations")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("turn").cast("int"))
    seen = c.select(F.col("conv_id").alias("document_id"), T.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"), at.alias("fetched_at"), F.lit(None).cast("string").alias("version_label"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    first = seen.groupBy("document_id").agg(F.min("fetched_at").alias("fetched_at"))
    old = seen.join(first, ["document_id", "fetched_at"]).withColumns({"version_label": F.lit("first"), "published_at": F.col("fetched_at"), "is_current": F.lit(True)})
    return old, seen


@query(f"""
    WITH {_VERSIONS}
    SELECT coalesce(old.document_id, new.document_id) AS document_id, coalesce(old.h, new.h) AS content_hash, CASE WHEN old.h IS NOT NULL THEN 'first' ELSE strftime(new.f, '%Y-%m-%d') END AS version_label, greatest(old.f, new.f) AS fetched_at, new.h IS NOT NULL AS is_current
    FROM old FULL JOIN new ON old.document_id = new.document_id AND old.h = new.h
""")
def committed_versions(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.versions_committed(*_versions(spark, sf)).select("document_id", "content_hash", "version_label", "fetched_at", "is_current")


@query(f"WITH {_VERSIONS} SELECT document_id, h AS content_hash, greatest(old.f, n.f) AS fetched_at, CASE WHEN document_id % 2 = 0 THEN 'new' ELSE 'e' END AS etag FROM old LEFT JOIN (SELECT document_id, f FROM new WHERE document_id % 2 = 0) n USING (document_id)")
def refreshed_versions(spark: SparkSession, sf: str) -> DataFrame:
    old, seen = _versions(spark, sf)
    answers = seen.where("document_id % 2 = 0").select("document_id", F.lit("new").alias("etag"), "last_modified", "fetched_at")
    return catalog.refreshed_validators(old, answers).select("document_id", "content_hash", "fetched_at", "etag")


@query("""
    WITH s AS (SELECT c_custkey AS version_id, c_nationkey AS document_id, c_custkey % 3 = 0 AS cur, c_custkey % 2 = 0 AS pend FROM customer), n AS (SELECT o_custkey AS version_id, count(*) AS n FROM orders GROUP BY 1),
    g AS (SELECT s.*, pend AND coalesce(n BETWEEN 1 AND 1024, false) AS go FROM s LEFT JOIN n USING (version_id)), w AS (SELECT *, bool_or(go) OVER (PARTITION BY document_id) AS any_go FROM g)
    SELECT version_id, document_id, CASE WHEN any_go THEN go ELSE cur END AS is_current, pend AND NOT go AS pending_current FROM w
""")
def promoted_versions(spark: SparkSession, sf: str) -> DataFrame:
    staged = table(spark, sf, "customer").select(F.col("c_custkey").alias("version_id"), F.col("c_nationkey").alias("document_id"), (F.col("c_custkey") % 3 == 0).alias("is_current"), (F.col("c_custkey") % 2 == 0).alias("pending_current"))
    return catalog.promoted(staged, table(spark, sf, "orders").select(F.col("o_custkey").alias("version_id")))


@query("""
    WITH d AS (SELECT user_id AS document_id, min(ts) AS f FROM events GROUP BY 1), s AS (SELECT user_id AS document_id, max(ts) AS l FROM events WHERE event_type < 'm' GROUP BY 1)
    SELECT document_id, greatest(f, l) AS last_seen_at FROM d LEFT JOIN s USING (document_id)
""")
def touched_documents(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    documents = e.groupBy(F.col("user_id").alias("document_id")).agg(F.min("ts").alias("last_seen_at"))
    return catalog.touched(documents, e.where("event_type < 'm'").select(F.col("user_id").alias("document_id"), F.col("ts").alias("observed_at")))


_RUNS = "SELECT event_id AS run_id, event_type AS source_id, CASE WHEN event_id % 4 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status, ts FROM events"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("source_id"), F.when(F.col("event_id") % 4 == 0, "RUNNING").otherwise("SUCCESS").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"))


@query(f"WITH r AS ({_RUNS}), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, run_id DESC) AS n FROM r WHERE status = 'RUNNING') SELECT run_id, source_id, 'FAILED' AS status FROM k WHERE n > 1")
def overlapping_runs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.overlapping_runs(_runs(spark, sf))


@query(f"""
    WITH r AS ({_RUNS}), e AS (SELECT * FROM r WHERE status <> 'RUNNING'), kept AS (SELECT run_id FROM e ORDER BY run_id DESC LIMIT 100)
    SELECT run_id FROM e WHERE ts < TIMESTAMP '2024-01-15' - INTERVAL 5 DAY AND run_id NOT IN (SELECT run_id FROM kept)
""")
def expired_runs(spark: SparkSession, sf: str) -> DataFrame:
    return retention.expired_runs(_runs(spark, sf), F.lit("2024-01-15").cast("timestamp"), 5, 100).select("run_id")


@query("SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN user_id END AS run_id FROM (SELECT event_id, user_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS gone FROM events) WHERE NOT gone AND event_id % 6 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 6 = 0 OR user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def detached_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("run_id"))
    return retention.detached(e, table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("run_id")))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-15'")
def unexpired_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("expires_at"))
    return retention.unexpired(e, F.lit("2024-01-15").cast("timestamp"), "3 DAYS").select("event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return lookup(table(spark, sf, "orders"), keys, ["o_custkey"]).select("o_orderkey", "o_custkey")


# --- audits and gates ---------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT n_nationkey AS source_key, n_nationkey % 5 <> 0 AS enabled FROM nation WHERE n_nationkey <> 3),
    d AS (SELECT c_custkey AS document_id, c_nationkey AS source_key, CASE WHEN c_acctbal > 0 THEN 'ACTIVE' ELSE 'STALE' END AS status, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 10 END AS cv FROM customer),
    v AS (SELECT c_custkey * 10 AS version_id, c_custkey + CASE WHEN c_custkey % 19 = 0 THEN 1000000000 ELSE 0 END AS document_id, c_custkey % 13 <> 0 AS is_current FROM customer WHERE c_custkey % 11 <> 0),
    x AS (SELECT o_orderkey AS section_id, o_custkey * 10 AS version_id FROM orders), i AS (SELECT o_orderkey AS section_id FROM orders WHERE o_orderkey % 17 <> 0),
    p AS (SELECT document_id, cv AS version_id FROM d WHERE cv IS NOT NULL), f AS (SELECT document_id, version_id FROM v WHERE is_current),
    w AS (SELECT section_id FROM x WHERE version_id IN (SELECT f.version_id FROM f JOIN p USING (document_id, version_id) JOIN d USING (document_id) JOIN s USING (source_key) WHERE enabled AND status = 'ACTIVE'))
    SELECT code, count(*) AS n FROM (
        SELECT 'ACTIVE_WITHOUT_VERSION' AS code FROM d WHERE status = 'ACTIVE' AND cv IS NULL UNION ALL SELECT 'BAD_POINTER' FROM p ANTI JOIN v USING (document_id, version_id)
        UNION ALL SELECT 'POINTED_NOT_FLAGGED' FROM p JOIN v USING (document_id, version_id) WHERE NOT is_current UNION ALL SELECT 'FLAGGED_NOT_POINTED' FROM f ANTI JOIN p USING (document_id, version_id)
        UNION ALL SELECT 'VERSION_WITHOUT_SECTIONS' FROM f WHERE version_id NOT IN (SELECT version_id FROM x) UNION ALL SELECT 'MISSING_IN_INDEX' FROM w WHERE section_id NOT IN (SELECT section_id FROM i)
        UNION ALL SELECT 'ORPHAN_IN_INDEX' FROM i WHERE section_id NOT IN (SELECT section_id FROM w) UNION ALL SELECT 'VERSION_WITHOUT_DOCUMENT' FROM v WHERE document_id NOT IN (SELECT document_id FROM d)
        UNION ALL SELECT 'SECTION_WITHOUT_VERSION' FROM x WHERE version_id NOT IN (SELECT version_id FROM v) UNION ALL SELECT 'DOCUMENT_WITHOUT_SOURCE' FROM d WHERE source_key NOT IN (SELECT source_key FROM s)
    ) GROUP BY 1
""")
def integrity_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents of nations, with versions and orders as sections, some of them out of order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    sources = table(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("source_key"), (F.col("n_nationkey") % 5 != 0).alias("enabled"))
    version = F.col("c_custkey") * 10
    documents = c.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("source_key"), F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("STALE").alias("status"), F.when(F.col("c_custkey") % 7 != 0, version).alias("current_version_id"))
    versions = c.where("c_custkey % 11 <> 0").select(version.alias("version_id"), (F.col("c_custkey") + F.when(F.col("c_custkey") % 19 == 0, 1_000_000_000).otherwise(0)).alias("document_id"), (F.col("c_custkey") % 13 != 0).alias("is_current"))
    held = o.select(F.col("o_orderkey").alias("section_id"), (F.col("o_custkey") * 10).alias("version_id"))
    issues = audit.integrity_issues(sources, documents, versions, held, o.where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("section_id")))
    return issues.groupBy("code").agg(F.count("*").alias("n"))


@query(f"""
    WITH e AS (SELECT event_id % 500 AS k, ((event_id % 256) * 16777216 + ((event_id * 7) % 256) * 65536 + ((event_id * 13) % 256) * 256 + user_id % 256) AS n FROM events),
    p AS (SELECT k, bool_and(NOT ({' OR '.join(f'n BETWEEN {a} AND {b}' for a, b in audit.blocked_ranges())})) AS public FROM e GROUP BY 1)
    SELECT CASE k % 4 WHEN 0 THEN 'https://h' || k || '.example.org/a' WHEN 1 THEN 'ftp://h' || k || '.example.org/' WHEN 2 THEN 'https://u@h' || k || '.example.org/' ELSE 'http://h' || k || '.example.org:81/' END AS url,
           CASE k % 4 WHEN 0 THEN CASE WHEN NOT public THEN 'PRIVATE_ADDRESS' END WHEN 1 THEN 'SCHEME' WHEN 2 THEN 'CREDENTIALS' ELSE 'PORT' END AS reason FROM p
""")
def url_reasons(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda x: F.pmod(x, F.lit(256)).cast("string")
    e, k = F.col("event_id"), (F.col("event_id") % 500).cast("string")
    made = F.element_at(F.array(
        F.concat(F.lit("https://h"), k, F.lit(".example.org/a")), F.concat(F.lit("ftp://h"), k, F.lit(".example.org/")), F.concat(F.lit("https://u@h"), k, F.lit(".example.org/")), F.concat(F.lit("http://h"), k, F.lit(".example.org:81/")),
    ), (e % 500 % 4 + 1).cast("int"))
    return audit.url_safety(table(spark, sf, "events").select(made.alias("url"), F.concat_ws(".", part(e), part(e * 7), part(e * 13), part(F.col("user_id"))).alias("ip")))


@query(f"""
    WITH {_URLS}, p AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM c)
    SELECT url, CASE WHEN regexp_matches(path, '^/.*1') THEN true WHEN starts_with(path, '/a') OR starts_with(path, '/p') THEN false ELSE true END AS allowed FROM p
""")
def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("url")
    u = F.col("url")
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a # no\nDisallow: /p\nAllow: /*1\nDisallow:\n"
    files = pages.select(F.concat(urls.scheme(u), F.lit("://"), F.lower(urls.authority(u))).alias("origin")).distinct().withColumn("body", F.lit(body))
    return audit.robots_decisions(pages, audit.robots_rules(files, "loomstone"))


@query("""
    SELECT o_orderkey, CASE WHEN g >= 0.02 AND l <= 2.5 AND p <= 150 THEN 'adopt_rerank' WHEN r >= 0.85 AND m >= 0.7 AND n >= 0.75 AND p <= 150 THEN 'keep_lexical' ELSE 'evaluate_embeddings' END AS recommendation, g >= 0.02 AND (m >= 0.1 OR n >= 0.1) AND p <= 150 AS adopt
    FROM (SELECT o_orderkey, (o_orderkey % 100) / 100 AS r, (o_custkey % 100) / 100 AS m, (o_orderkey % 97) / 97 AS n, CAST(o_custkey % 200 AS DOUBLE) AS p, (o_orderkey % 7) / 100 AS g, (o_custkey % 5) / 1.0 AS l FROM orders)
""")
def strategy_gates(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    row = table(spark, sf, "orders").select(
        "o_orderkey", (k % 100 / 100).alias("recall"), (c % 100 / 100).alias("mrr"), (k % 97 / 97).alias("ndcg"), (c % 200).cast("double").alias("p95"), (k % 7 / 100).alias("gain"), (c % 5 / 1).alias("latency_ratio"),
        (c % 100 / 100).alias("paraphrase_gain"), (k % 97 / 97).alias("multi_gain"),
    )
    return evaluate.fusion_gate(evaluate.strategy(row)).select("o_orderkey", "recommendation", "adopt")


@query("SELECT o_custkey AS query_id, min(o_totalprice % 1000) / 1000 AS worst_recall FROM orders GROUP BY 1 HAVING min(o_totalprice % 1000) / 1000 < 1")
def recall_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failures(table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_totalprice") % 1000 / 1000).alias("recall")))


@query("SELECT a AS bounded, b AS whole, round(100 * (1 - a / b), 2) AS reduction_percent FROM (SELECT sum(least(length(text), 500)) AS a, sum(length(text)) AS b FROM documents)")
def size_reductions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select(F.length("text").cast("long").alias("n"))
    return evaluate.size_reduction(n.select(F.least("n", F.lit(500)).alias("n")), n, "n")


@query(f"""
    WITH {_DENSE}, a AS (SELECT query_id, list(vec_id) AS x FROM r WHERE position <= 10 GROUP BY 1), b AS (SELECT query_id, list(vec_id) AS y FROM r WHERE position > 5 AND position <= 15 GROUP BY 1)
    SELECT round(avg(len(list_intersect(x, y)) / 10.0), 6) AS overlap FROM a JOIN b USING (query_id)
""")
def ranking_overlap(spark: SparkSession, sf: str) -> DataFrame:
    top = _dense(spark, sf, 15)
    later = top.where("position > 5").withColumn("position", F.col("position") - 5)
    return vectors.overlap_at(top, later, 10, "vec_id")
