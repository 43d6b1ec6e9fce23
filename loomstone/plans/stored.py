"""Queries over stores and addresses, and their SQL: commits of several tables, kept history, IPv6, approved links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import audit, commits
from ..operators.pages import approved_links, extracted
from ..sources.readers import table
from ..sources.sinks import Store, shared_folder
from .registry import _URLS, query


def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/loomstone/{name}-{uuid.uuid4().hex}")


@query("""
    WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, sha256(coalesce(text, '')) AS h, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * turn AS f,
                      CASE WHEN conv_id % 7 = 3 AND turn > 0 THEN 0 ELSE conv_id % 3 + 1 END AS n, turn % 2 AS batch FROM conversations),
    last AS (SELECT *, row_number() OVER (PARTITION BY document_id, batch ORDER BY f DESC, h DESC) AS k FROM t),
    picked AS (SELECT * FROM last WHERE k = 1), one AS (SELECT * FROM picked WHERE batch = 0 AND n > 0),
    two AS (SELECT p.* FROM picked p LEFT JOIN one USING (document_id, h) WHERE p.batch = 1 AND (p.n > 0 OR one.h IS NOT NULL)),
    every AS (SELECT document_id, h, n, batch FROM one UNION ALL SELECT document_id, h, n, batch FROM two)
    SELECT document_id, h AS content_hash, max(batch) = 1 OR document_id NOT IN (SELECT document_id FROM two) AS is_current, CAST(coalesce(max_by(n, batch) FILTER (WHERE n > 0), 0) AS BIGINT) AS sections FROM every GROUP BY 1, 2
""")
def version_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as observed versions, even turns in one commit, odd ones in the next; some have no sections and are turned down."""
    c = table(spark, sf, "conversations")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))
    n = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") > 0), 0).otherwise(F.col("conv_id") % 3 + 1)
    seen = c.select(F.col("conv_id").cast("string").alias("document_id"), T.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"), at.alias("fetched_at"), (F.col("turn") % 2).alias("batch"), n.alias("n"))
    empty = {c: F.lit(None).cast(t) for c, t in (("version_label", "string"), ("published_at", "timestamp"), ("etag", "string"), ("last_modified", "string"))}
    store = _store(spark, "catalog")
    for batch in (0, 1, 1):  # the last one is a replay, and changes nothing
        part = seen.where(F.col("batch") == batch)
        observed = part.withColumns(empty).select("document_id", "content_hash", *empty, "fetched_at")
        # Of a document's versions of a batch the latest has its sections committed.
        ordinal = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("ordinal")
        sections = part.where("n > 0").select("document_id", "content_hash", ordinal).distinct().select("*", F.lit("h").alias("heading"), F.lit("text").alias("content"))
        commits.commit(store, observed, sections, ("versions", batch))
    return commits.section_counts(store)


@query("""
    WITH n AS (SELECT max(ts) AS newest FROM events) SELECT event_id AS request_id, event_type AS tool, ts AS executed_at FROM events, n WHERE ts >= newest - INTERVAL 12 DAY
""")
def kept_history(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a history by day in four batches of overlapping spans, each keeping twelve days; every request once."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("tool"), F.col("ts").alias("executed_at"))
    span = e.agg(F.min("executed_at").alias("a"), F.max("executed_at").alias("b"))
    part = lambda f: F.col("a") + (F.col("b") - F.col("a")) * f
    store = _store(spark, "history")
    for k in range(4):
        rows = e.join(F.broadcast(span)).where((F.col("executed_at") >= part((k - 0.5) / 4)) & (F.col("executed_at") <= part((k + 1) / 4))).select(*e.columns)
        commits.append_history(store, rows, 12, ("history", k))
        commits.append_history(store, rows, 12, ("history", k))
    return store.read("history").drop("day")


_SIX = """
    e AS (SELECT event_id, CAST(event_id % 4 AS INT) AS kind, CAST((event_id * 37) % 8192 + 8192 AS BIGINT) AS a, CAST((event_id * 97) % 65536 AS BIGINT) AS b, CAST(user_id % 65536 AS BIGINT) AS c,
          CAST((event_id % 256) * 16777216 + ((event_id * 7) % 256) * 65536 + ((event_id * 13) % 256) * 256 + user_id % 256 AS BIGINT) AS v4 FROM events),
    w AS (SELECT event_id, kind, v4, CASE kind WHEN 0 THEN a * 65536 + c WHEN 1 THEN 8193 * 65536 + b END AS top FROM e)
"""


@query(f"""
    WITH {_SIX}
    SELECT event_id, CASE WHEN kind >= 2 THEN NOT ({' OR '.join(f'v4 BETWEEN {a} AND {b}' for a, b in audit.blocked_ranges())})
           ELSE top <> 536939960 AND ({' OR '.join(f'top >> {32 - b} = {hi >> 32 >> (32 - b)}' for b, hi, _ in map(audit.range_words, audit.ALLOCATED))}) END AS public FROM w
""")
def ipv6_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses made of event ids, in several spellings: short and full IPv6, IPv4 within it as groups and as numbers with dots."""
    e, u = F.col("event_id"), F.col("user_id")
    hexed = lambda x: F.lower(F.hex(x.cast("long")))
    a, b, c = e * 37 % 8192 + 8192, e * 97 % 65536, u % 65536
    part = lambda x: F.pmod(x, F.lit(256))
    bytes_ = [part(e), part(e * 7), part(e * 13), part(u)]
    spelled = F.element_at(F.array(
        F.concat(hexed(a), F.lit(":"), hexed(c), F.lit("::"), hexed(b)), F.concat(F.lit("2001:"), F.upper(hexed(b)), F.lit(":0:0:00:0000:0:"), hexed(c)),
        F.concat(F.lit("::ffff:"), F.concat_ws(".", *[x.cast("string") for x in bytes_])), F.concat(F.lit("[0:0:0:0:0:FFFF:"), hexed(bytes_[0] * 256 + bytes_[1]), F.lit(":"), hexed(bytes_[2] * 256 + bytes_[3]), F.lit("]")),
    ), (e % 4 + 1).cast("int"))
    return audit.with_public(table(spark, sf, "events").select("event_id", spelled.alias("ip"))).select("event_id", "public")


@query(f"""
    WITH {_URLS}, n AS (SELECT count(*) AS pages FROM c), j AS (SELECT p.page_id, k, q.canonical AS link, q.host, q.scheme, q.page_id AS target FROM c p, n, (SELECT unnest(range(1, 9)) AS k) JOIN c q ON q.page_id = (p.page_id * 7 + k * k) % pages),
    once AS (SELECT page_id, link, min(k) AS k, any_value(host) AS host FROM j GROUP BY 1, 2),
    good AS (SELECT page_id, link, k FROM once WHERE length(host) % 3 <> 0 AND (length(host) % 3 <> 1 OR ascii(host) % 2 = 0))
    SELECT page_id, link, n FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY k) AS n FROM good) WHERE n <= 3
""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose text links to eight others, in documents of HTML made here; a third of the hosts have no address, some a private one."""
    p = table(spark, sf, "pages").select("page_id", "url")
    n = p.count()
    to = F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.struct(k.alias("k"), ((F.col("page_id") * 7 + k * k) % n).alias("target")))).alias("t")
    linked = p.select("page_id", "url", to).select("page_id", "url", "t.*").join(p.select(F.col("page_id").alias("target"), F.col("url").alias("href")), "target")
    anchors = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit('<p><a href="'), F.replace("href", F.lit("&"), F.lit("&amp;")), F.lit('">next</a></p>')).alias("a"))))
    made = linked.groupBy("page_id", "url").agg(F.concat(F.lit("<html><body><h1>Links</h1>"), F.array_join(F.transform(anchors, lambda x: x["a"]), ""), F.lit("</body></html>")).alias("html"))
    host = urls.host(urls.canonical_url(F.col("url")))
    size = F.length("host") % 3
    public, private = F.when(F.ascii("host") % 2 == 0, "2600::7").otherwise("fe80::1"), F.lit("93.184.216.34")
    addresses = p.select(host.alias("host")).distinct().where(size != 0).select("host", F.explode(F.array(F.when(size == 1, public).otherwise(private), F.lit("8.8.8.8"))).alias("ip"))
    return approved_links(extracted(made), addresses, 3).select("page_id", "link", F.col("n").cast("long").alias("n"))
