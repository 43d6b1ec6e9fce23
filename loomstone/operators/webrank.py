"""Web results: registry match, trust, score, filters, one row per canonical URL, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions import text as T
from ..sources.sinks import materialized
from .retention import running
from .search import containing

#: What a source's class adds to a score.
SIGNAL = {"VERIFIED_OFFICIAL": 0.5, "LIKELY_OFFICIAL": 0.28, "THIRD_PARTY": -0.08, "UNKNOWN": 0.0}


def registry_match(rows: DataFrame, registry: DataFrame, key: list[str], url: str = "url") -> DataFrame:
    """rows with source_id and priority of the first enabled registry entry that covers the URL, by equi-joins on host suffixes.

    registry: ordinal, id, domain, base_url, path_prefix, include_subdomains, organizations, priority, enabled - of any size; Spark broadcasts it where it is small.
    """
    u = F.col(url)
    entries = registry.where("enabled").withColumn("entry_port", urls.port(F.col("base_url")))
    by_host = rows.where(urls.scheme(u) == "https").select(*key, url, F.explode(urls.host_suffixes(urls.host(u))).alias("suffix"))
    prefix = F.regexp_replace(F.coalesce("path_prefix", F.lit("")), r"/+$", "")
    at = urls.path(u)
    covered = (prefix == "") | (at == prefix) | F.startswith(at, F.concat(prefix, F.lit("/")))
    hosts = by_host.join(entries, F.col("suffix") == F.lower("domain")).where(((urls.host(u) == F.lower("domain")) | F.col("include_subdomains")) & (urls.port(u) == F.col("entry_port")) & covered)
    owners = entries.select("ordinal", "id", "priority", F.explode("organizations").alias("organization"))
    code = rows.where((urls.scheme(u) == "https") & (urls.host(u) == "github.com")).select(*key, url, F.lower(F.split(at, "/")[1]).alias("owner"))
    hubs = code.join(owners, F.col("owner") == F.lower("organization"))
    both = hosts.select(*key, "ordinal", "id", "priority").unionByName(hubs.select(*key, "ordinal", "id", "priority"))
    best = both.groupBy(*key).agg(F.min_by(F.struct("id", "priority"), "ordinal").alias("m")).select(*key, F.col("m.id").alias("source_id"), F.col("m.priority").alias("priority"))
    return rows.join(best, key, "left")


def keyword_routes(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Enabled registry entries any keyword of which stands in the query, case aside. Blank keywords fit nothing.

    Queries and keywords meet by equi-joins on words or character grams, so either side may be large.
    """
    words = registry.where("enabled").select("id", "priority", F.explode(F.transform("keywords", lambda k: F.lower(T.trimmed(k)))).alias("keyword"))
    asked = words.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("query")).distinct()
    met = containing(queries.select(F.col("query_id").alias("section_id"), F.col("query").alias("content")), asked, ["content"])
    return met.select(F.col("section_id"), F.col("query_id").alias("keyword")).join(words, "keyword").select(F.col("section_id").alias("query_id"), "id", "priority").distinct()


def result_score(query: Column, title: Column, url: Column, provider: Column, status: Column, priority: Column) -> Column:
    terms = T.distinct_terms(query)
    text = F.lower(F.concat_ws(" ", urls.host(url), urls.path(url)))
    n = F.greatest(F.size(terms), F.lit(1))
    p = F.greatest(F.lit(0.0), F.when(F.isnan(provider) | (F.abs(provider) == float("inf")), 0.0).otherwise(F.coalesce(provider, F.lit(0.0))))
    signal = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNAL.items() for x in kv]), status)
    raw = (
        0.12 + 0.12 * p / (p + 10) + signal + 0.15 * F.size(F.array_intersect(terms, T.distinct_terms(title))) / n
        + 0.05 * F.size(F.filter(terms, lambda t: F.contains(text, t))) / n + F.when(rules.looks_documented(url), 0.05).otherwise(0.0)
        + 0.05 * F.least(F.coalesce(priority, F.lit(0)), F.lit(1000)) / 1000
    )
    return rules.clamp_score(raw)


def mapped(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Provider results (query_id, query, rank, title, url, snippet, score, engines, ...) as ranked-result rows; bad URLs go."""
    read = results.withColumn("url", urls.canonical_url(F.col("url"))).where("url is not null").withColumnRenamed("score", "provider_score")
    known = registry_match(read, registry, ["query_id", "rank"])
    host = urls.host(F.col("url"))
    title = F.coalesce(F.nullif(T.trimmed(F.coalesce("title", F.lit(""))), F.lit("")), host)
    status = rules.trust_class(F.col("url"), F.col("source_id").isNotNull())
    rest = [c for c in ("published_at", "updated_at", "language") if c in results.columns]
    out = known.withColumns({"domain": host, "title": title, "source_status": status})
    score = result_score(F.col("query"), F.col("title"), F.col("url"), F.col("provider_score"), F.col("source_status"), F.col("priority"))
    return out.select("query_id", "rank", "title", "url", "domain", T.trimmed(F.coalesce("snippet", F.lit(""))).alias("snippet"), "source_status", F.array_sort(F.array_distinct("engines")).alias("engines"), *rest, score.alias("score"))


def domain_filtered(rows: DataFrame, allow: DataFrame, deny: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, domain) lists on label boundaries: denied hosts go first; a query without allowed domains allows all."""
    suffixes = rows.select(*key, "query_id" if "query_id" not in key else key[0], F.explode(urls.host_suffixes(F.col("domain"))).alias("suffix")).select(*key, "suffix").distinct()
    bad = suffixes.join(deny.select("query_id", F.lower("domain").alias("suffix")), ["query_id", "suffix"], "left_semi").select(*key).distinct()
    good = suffixes.join(allow.select("query_id", F.lower("domain").alias("suffix")), ["query_id", "suffix"], "left_semi").select(*key).distinct()
    strict = allow.select("query_id").distinct().withColumn("listed", F.lit(True))
    left = rows.join(bad, key, "left_anti").join(strict, "query_id", "left")
    return left.where("listed is null").unionByName(left.where("listed").join(good, key, "left_semi")).drop("listed")


def policy_filtered(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """strict keeps verified sources only; prefer and any keep all."""
    return rows.join(policies, "query_id", "left").where((F.coalesce("policy", F.lit("any")) != "strict") | (F.col("source_status") == "VERIFIED_OFFICIAL"))


def ranked(rows: DataFrame, limit: int | None, oversample: int = 3) -> DataFrame:
    """One row per query and URL, the best one; then the best so many. The first oversample * limit of a provider count.

    With a limit each task keeps so many rows of a query before any move. Without one every row is ranked: by ranges of
    the whole order, less the rank that the query begins at, so a query of any number of results is no task of its own.
    """
    order = [F.col("score").desc(), F.lower("title"), F.col("url")]
    early = rows if limit is None else rows.where(F.col("rank") < oversample * limit)
    one = early.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "url").orderBy(*order, "rank"))).where("k = 1").drop("k")
    if limit is not None:
        return one.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= limit)
    keys = {"by_query": F.col("query_id"), "by_score": -F.coalesce("score", F.lit(0)), "by_title": F.coalesce(F.lower("title"), F.lit("")), "by_url": F.col("url")}
    keyed = materialized(one.withColumns(keys).withColumnRenamed("rank", "provider_rank"), "ranked")
    placed = materialized(running(keyed, list(keys), F.lit(1)).select(*keyed.columns, F.col("rank").alias("place")), "placed")
    begins = placed.groupBy("by_query").agg(F.min("place").alias("begin"))
    return placed.join(begins, "by_query").withColumnRenamed("provider_rank", "rank").withColumn("position", F.col("place") - F.col("begin") + 1).select(*one.columns, "position")


def unresponsive(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))
