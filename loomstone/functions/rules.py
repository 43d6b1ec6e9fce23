"""Classes, states and scores as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Hosts and labels that tell a source's kind.
THIRD_PARTY = ["dev.to", "medium.com", "quora.com", "reddit.com", "serverfault.com", "stackexchange.com", "stackoverflow.com", "superuser.com"]
COMMUNITY = ["blog", "community", "forum"]
DOCUMENTATION = ["api", "developer", "developers", "docs", "documentation", "learn", "reference", "support"]


def _lit(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def permanent_prefix(chain: Column) -> Column:
    """The leading run of permanent hops of an array of hops."""
    i = F.array_position(F.transform(chain, lambda h: h["permanent"]), False)
    return F.when(i == 0, chain).otherwise(F.slice(chain, F.lit(1), F.greatest(i - 1, F.lit(0)).cast("int")))


def permanent_target(chain: Column) -> Column:
    return F.try_element_at(permanent_prefix(chain), F.lit(-1))["to_url"]


def http_class(status: Column) -> Column:
    return (
        F.when(status == 304, "not_modified").when(status.isin(404, 410), "missing").when(status.isin(301, 308), "permanent_redirect")
        .when(status.between(300, 399), "redirect").when(status.isin(408, 425, 429) | (status >= 500), "transient")
        .when(status.between(200, 299), "ok").otherwise("error")
    )


def ttl_class(url: Column) -> Column:
    p = F.lower(urls.path(url))
    return F.when(p.rlike(r"/readme(?:\.[a-z0-9]+)?$"), "readme").when(p.endswith("/sitemap.xml"), "sitemap").otherwise("documentation")


def freshness(expires: Column, now: Column, retention: str) -> Column:
    return F.when(expires > now, "fresh").when(expires + F.expr(f"INTERVAL {retention}") > now, "stale").otherwise("expired")


def looks_documented(url: Column) -> Column:
    parts = F.concat(F.split(urls.host(url), r"\."), F.split(F.lower(urls.path(url)), "/"))
    return F.arrays_overlap(parts, _lit(DOCUMENTATION))


def trust_class(url: Column, verified: Column) -> Column:
    parts = F.concat(F.split(urls.host(url), r"\."), F.split(F.lower(urls.path(url)), "/"))
    third = F.arrays_overlap(urls.host_suffixes(urls.host(url)), _lit(THIRD_PARTY)) | F.arrays_overlap(parts, _lit(COMMUNITY))
    return (
        F.when(F.coalesce(verified, F.lit(False)) & (urls.scheme(url) == "https"), "VERIFIED_OFFICIAL").when(third, "THIRD_PARTY")
        .when(looks_documented(url), "LIKELY_OFFICIAL").otherwise("UNKNOWN")
    )


def page_trust_class(url: Column, verified: Column) -> Column:
    """The narrower rule for pages that were read."""
    likely = F.startswith(urls.host(url), F.lit("docs.")) | F.arrays_overlap(F.split(F.lower(urls.path(url)), "/"), _lit(["docs", "documentation", "reference"]))
    return F.when(F.coalesce(verified, F.lit(False)) & (urls.scheme(url) == "https"), "VERIFIED_OFFICIAL").when(likely, "LIKELY_OFFICIAL").otherwise("UNKNOWN")


def clamp_score(x: Column) -> Column:
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite, F.lit(0.0)))), 6)


def plain_links(x: Column) -> Column:
    """Distinct canonical URLs that stand in a text."""
    found = F.regexp_extract_all(x, F.lit(r"https?://[^\s<>\"'()\[\]]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda u: urls.canonical_url(F.regexp_replace(u, r"[.,;:!?]+$", ""))), lambda u: u.isNotNull()))


def parsed_date(x: Column) -> Column:
    return F.date_format(F.try_to_timestamp(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_text(x: Column, *paths: str) -> Column:
    """The first of some paths that a JSON text has."""
    return F.coalesce(*(F.try_variant_get(F.try_parse_json(x), p, "string") for p in paths))


def conditional_allowed(validator_url: Column, request_url: Column, etag: Column, modified: Column) -> Column:
    """A conditional request is made only for the URL the validators came from, and with headers that are safe."""
    safe = lambda h: h.isNull() | ((F.length(h) <= 1024) & ~h.rlike(r"[\r\n]"))
    return F.coalesce(validator_url == request_url, F.lit(False)) & (etag.isNotNull() | modified.isNotNull()) & safe(etag) & safe(modified)


def has_control(x: Column) -> Column:
    return x.rlike(r"[\x00-\x1f\x7f-\x9f]")


def search_query(x: Column) -> Column:
    """Trimmed and single-spaced, of 2 to 500 characters and without control characters; else null."""
    text = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(~has_control(x) & F.length(text).between(2, 500), text)
