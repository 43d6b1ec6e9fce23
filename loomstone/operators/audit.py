"""Audits: catalog integrity, index drift, URL safety, robots rules, and data-quality rules."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions import text as T
from ..sources.sinks import materialized
from .sections import expanded

ISSUE = ["code", "message", "key"]

#: IPv4 ranges that are not public.
BLOCKED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
#: IPv6 ranges that are allocated to registries, and the one among them that is for documentation. Other IPv6 addresses are not public.
ALLOCATED = [
    "2001:200::/23", "2001:400::/23", "2001:600::/23", "2001:800::/22", "2001:c00::/23", "2001:e00::/23", "2001:1200::/23", "2001:1400::/22", "2001:1800::/23", "2001:1a00::/23", "2001:1c00::/22", "2001:2000::/19",
    "2001:4000::/23", "2001:4200::/23", "2001:4400::/23", "2001:4600::/23", "2001:4800::/23", "2001:4a00::/23", "2001:4c00::/23", "2001:5000::/20", "2001:8000::/19", "2001:a000::/20", "2001:b000::/20", "2003::/18",
    "2400::/12", "2410::/12", "2600::/12", "2610::/23", "2620::/23", "2630::/12", "2800::/12", "2a00::/12", "2a10::/12", "2c00::/12",
]
DOCUMENTATION = ["2001:db8::/32"]
PORTS = [80, 443]
LOCAL_NAMES = r"^localhost$|\.localhost$|\.local$|\.internal$"


def _issue(rows: DataFrame, code: str, message: str, key: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(message).alias("message"), key.cast("string").alias("key"))


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of child whose key, where it is not null, has no parent."""
    given = child
    for c in on:
        given = given.where(F.col(c).isNotNull())
    return given.join(parent.select(*on).distinct(), on, "left_anti")


def integrity_issues(sources: DataFrame, documents: DataFrame, versions: DataFrame, sections: DataFrame, indexed: DataFrame) -> DataFrame:
    """All issues of a catalog snapshot; indexed: the section ids that the index has."""
    pointed = documents.where("current_version_id is not null").select("document_id", F.col("current_version_id").alias("version_id"))
    flagged = versions.where("is_current").select("document_id", "version_id")
    live = flagged.join(pointed, ["document_id", "version_id"])
    with_sections = sections.select("version_id").distinct()
    open_docs = documents.join(sources.where("enabled").select("source_key"), "source_key", "left_semi").where("status = 'ACTIVE'").select("document_id")
    wanted = sections.join(live.join(open_docs, "document_id", "left_semi"), "version_id", "left_semi").select("section_id")
    parts = [
        _issue(documents.where("status = 'ACTIVE' and current_version_id is null"), "ACTIVE_WITHOUT_VERSION", "an active document has no current version", F.col("document_id")),
        _issue(pointed.join(versions.select("document_id", "version_id"), ["document_id", "version_id"], "left_anti"), "BAD_POINTER", "the current version is missing or of another document", F.col("document_id")),
        _issue(pointed.join(versions.where("not is_current"), ["document_id", "version_id"], "left_semi"), "POINTED_NOT_FLAGGED", "the version pointed to is not flagged current", F.col("version_id")),
        _issue(flagged.join(pointed, ["document_id", "version_id"], "left_anti"), "FLAGGED_NOT_POINTED", "a version flagged current is not pointed to", F.col("version_id")),
        _issue(flagged.join(with_sections, "version_id", "left_anti"), "VERSION_WITHOUT_SECTIONS", "a current version has no sections", F.col("version_id")),
        _issue(wanted.join(indexed.select("section_id").distinct(), "section_id", "left_anti"), "MISSING_IN_INDEX", "a searchable section is not indexed", F.col("section_id")),
        _issue(indexed.select("section_id").distinct().join(wanted, "section_id", "left_anti"), "ORPHAN_IN_INDEX", "an indexed section is not searchable", F.col("section_id")),
        _issue(orphans(versions, documents, ["document_id"]), "VERSION_WITHOUT_DOCUMENT", "a version's document is missing", F.col("version_id")),
        _issue(orphans(sections, versions, ["version_id"]), "SECTION_WITHOUT_VERSION", "a section's version is missing", F.col("section_id")),
        _issue(orphans(documents, sources, ["source_key"]), "DOCUMENT_WITHOUT_SOURCE", "a document's source is missing", F.col("document_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("issues"), F.count_distinct("code").alias("kinds")).withColumn("status", F.when(F.col("issues") == 0, "OK").otherwise("FAILED"))


def catalog_summary(sources: DataFrame, documents: DataFrame, sections: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row of counts; each table is read once."""
    s = sources.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources"))
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ACTIVE").alias("active_documents"))
    c = sections.agg(F.count("*").alias("current_sections"))
    i = indexed.agg(F.count_distinct("section_id").alias("indexed_sections"))
    return s.join(F.broadcast(d)).join(F.broadcast(c)).join(F.broadcast(i))


def one_sided(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows that a side has more often than the other, as often as it has more of them, with the side; both are read once."""
    both = stored.withColumn("_d", F.lit(1)).unionByName(fresh.withColumn("_d", F.lit(-1)))
    net = both.groupBy(*stored.columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    side = F.when(F.col("_d") > 0, F.lit("stored")).otherwise(F.lit("fresh")).alias("side")
    return net.select(*stored.columns, side, F.explode(F.sequence(F.lit(1), F.abs("_d"))).alias("_n")).drop("_n")


def index_drift(stored: DataFrame, fresh: DataFrame, key: str = "section_id") -> DataFrame:
    """(key, side, field, pos, term) of postings that only one side has. Digests per section are compared first."""
    item = [key, "field", "pos", "term"]

    def digest(d: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64("field", "pos", "term")
        return d.groupBy(key).agg(F.struct(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 32))).alias("s"), F.count("*").alias("n")).alias(name))

    differ = digest(stored, "a").join(digest(fresh, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)
    one, two = stored.select(*item).join(differ, key, "left_semi"), fresh.select(*item).join(differ, key, "left_semi")
    return one_sided(one, two)


def token_drift(stored: DataFrame, fresh: DataFrame, key: str = "section_id") -> DataFrame:
    """The same from token arrays (key, fields, of tokens_by_field): sections are compared whole, and only those that differ become postings."""
    # Written, so that the texts behind them are tokenised once.
    stored, fresh = materialized(stored, "drift-stored"), materialized(fresh, "drift-fresh")
    digest = lambda d, name: d.select(key, F.struct(F.xxhash64("fields").alias("x"), F.xxhash64(F.lit(1), "fields").alias("y")).alias(name))
    differ = digest(stored, "a").join(digest(fresh, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)
    differ = materialized(differ.distinct(), "drift")
    one, two = (expanded(d.join(differ, key, "left_semi"), key) for d in (stored, fresh))
    return one_sided(one, two)


def blocked_ranges() -> list[tuple[int, int]]:
    out = []
    for r in BLOCKED:
        base, bits = r.split("/")
        n = sum(int(p) << 8 * (3 - i) for i, p in enumerate(base.split(".")))
        out.append((n, n + (1 << 32 - int(bits)) - 1))
    return out


def range_words(cidr: str) -> tuple[int, int, int]:
    """(bits, hi, lo) of a range, IPv4 within IPv6; hi and lo as signed longs."""
    net = ipaddress.ip_network(cidr)
    bits, value = (net.prefixlen, int(net.network_address)) if net.version == 6 else (net.prefixlen + 96, int(net.network_address) | 0xFFFF << 32)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return bits, signed(value >> 64), signed(value & (1 << 64) - 1)


def public_ranges() -> list[tuple[int, int, int, bool]]:
    """(bits, hi, lo, public): all IPv4 but what is blocked, and the allocated IPv6; the longest range that holds an address decides."""
    told = [(c, True) for c in ("0.0.0.0/0", *ALLOCATED)] + [(c, False) for c in (*BLOCKED, *DOCUMENTATION)]
    return [(*range_words(c), public) for c, public in told]


def longest_prefix(rows: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """rows (hi, lo, ...) with the value of the longest range (bits, hi, lo, value) that holds them, null where none does.

    Each distinct address is looked up by equi-joins, once per prefix length that the ranges have, so the ranges may be of any number.
    """
    lengths = sorted(r[0] for r in ranges.select("bits").distinct().collect())  # at most 129
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [signed((1 << 128) - (1 << 128 - b) >> 64) for b in lengths], [signed((1 << 128) - (1 << 128 - b) & (1 << 64) - 1) for b in lengths]
    cut = F.array(*[F.struct(F.lit(b).alias("bits"), F.col("hi").bitwiseAND(F.lit(h).cast("long")).alias("m_hi"), F.col("lo").bitwiseAND(F.lit(w).cast("long")).alias("m_lo")) for b, h, w in zip(lengths, *masks, strict=True)])
    if not lengths:
        return rows.withColumn(value, F.lit(None).cast(ranges.schema[value].dataType))
    asked = rows.where("hi is not null").select("hi", "lo").distinct().select("hi", "lo", F.explode(cut).alias("c")).select("hi", "lo", "c.*")
    met = asked.join(ranges.select("bits", F.col("hi").alias("m_hi"), F.col("lo").alias("m_lo"), value), ["bits", "m_hi", "m_lo"])
    return rows.join(met.groupBy("hi", "lo").agg(F.max_by(value, "bits").alias(value)), ["hi", "lo"], "left")


def with_public(rows: DataFrame, ip: str = "ip") -> DataFrame:
    """rows with public: whether the address may be fetched; false for what is no address, null for null."""
    ranges = rows.sparkSession.createDataFrame(public_ranges(), "bits int, hi long, lo long, public boolean")
    words = rows.withColumn("_w", urls.address_words(F.col(ip))).withColumns({"hi": F.col("_w.hi"), "lo": F.col("_w.lo")}).drop("_w", "public")
    return longest_prefix(words, ranges, "public").withColumn("public", F.when(F.col(ip).isNotNull(), F.coalesce("public", F.lit(False)))).drop("hi", "lo")


def public_address(ip: Column) -> Column:
    """The same as an expression, by comparing with every range: for a few addresses."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def decided(w: Column) -> Column:
        rules_ = []
        for bits, hi, lo, public in sorted(public_ranges(), reverse=True):  # the longest range first
            mask = (1 << 128) - (1 << 128 - bits)
            held = (w["hi"].bitwiseAND(F.lit(signed(mask >> 64)).cast("long")) == hi) & (w["lo"].bitwiseAND(F.lit(signed(mask & (1 << 64) - 1)).cast("long")) == lo)
            rules_.append(F.when(held, F.lit(public)))
        return F.coalesce(*rules_, F.lit(False))

    return urls.let(urls.address_words(ip), decided)


def url_safety(resolved: DataFrame) -> DataFrame:
    """(url, ip) rows, a row per address -> (url, reason): null where the URL may be fetched."""
    u = F.col("url")
    seen = with_public(resolved.select("url", "ip")).groupBy("url").agg(F.count("ip").alias("n"), F.bool_and("public").alias("public"))
    reason = (
        F.when(F.coalesce(urls.scheme(u), F.lit("")).isin("http", "https") == False, "SCHEME")  # noqa: E712
        .when(F.contains(urls.authority(u), F.lit("@")), "CREDENTIALS").when(urls.host(u).rlike(LOCAL_NAMES), "LOCAL_HOST")
        .when(~urls.port(u).isin(PORTS), "PORT").when(urls.domain_name(urls.host(u)).isNull(), "HOST").when(F.col("n") == 0, "NO_ADDRESS").when(~F.col("public"), "PRIVATE_ADDRESS")
    )
    return seen.select("url", reason.alias("reason"))


def _octets(x: Column) -> Column:
    """Percent forms in upper case, and unreserved characters written plainly."""
    out = x
    for c in "-._~":
        out = F.regexp_replace(out, f"(?i)%{ord(c):02x}", c)
    return F.regexp_replace(out, r"(?i)%2f", "%2F")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, body) -> origin, allow, pattern of the group that names the agent, else of *; consecutive agent lines share a group."""
    w = Window.partitionBy("origin").orderBy("n")
    lines = files.select("origin", F.posexplode(F.split("body", r"\r\n?|\n")).alias("n", "line"))
    line = F.trim(F.regexp_replace("line", r"#.*$", ""))
    parsed = lines.select("origin", "n", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_replace(line, r"^[^:]*:?", "")).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    is_agent = F.col("field") == "user-agent"
    begins = (is_agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")).cast("int")
    grouped = parsed.withColumn("group", F.sum(begins).over(w))
    name = F.lower(F.lit(agent))
    agents = grouped.where(is_agent).select("origin", "group", F.when(F.contains(name, F.lower("value")) & (F.col("value") != "*") & (F.col("value") != ""), 2).when(F.col("value") == "*", 1).alias("fit")).where("fit is not null")
    best = agents.groupBy("origin").agg(F.max("fit").alias("fit"))
    chosen = agents.join(best, ["origin", "fit"]).select("origin", "group").distinct()
    return grouped.where(~is_agent & (F.col("value") != "")).join(chosen, ["origin", "group"]).select("origin", (F.col("field") == "allow").alias("allow"), _octets(F.col("value")).alias("pattern"))


def robots_decisions(pages: DataFrame, rules_: DataFrame) -> DataFrame:
    """(url) -> url, allowed: the longest matching pattern decides, Allow wins ties, no match allows."""
    u = F.col("url")
    asked = pages.select("url", F.concat(urls.scheme(u), F.lit("://"), F.lower(urls.authority(u))).alias("origin"), _octets(F.concat(F.when(urls.path(u) == "", "/").otherwise(urls.path(u)), F.when(urls.query(u) != "", F.concat(F.lit("?"), urls.query(u))).otherwise(""))).alias("target")).distinct()
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([\\^.|?+()\[\]{}])", r"\\$1"), r"\*+", ".*")
    expression = F.concat(F.lit("^"), F.when(F.endswith("pattern", F.lit("$")), F.concat(F.expr("substring(q, 1, length(q) - 1)"), F.lit("$"))).otherwise(F.regexp_replace("q", r"\$", r"\\\$")))
    ready = rules_.withColumn("q", quoted).withColumn("regex", expression)
    hit = asked.join(ready, "origin", "left").withColumn("fits", F.expr("target rlike regex"))
    decided = hit.groupBy("url").agg(F.max_by("allow", F.when(F.col("fits"), F.struct(F.length("pattern"), "allow"))).alias("allow"))
    return decided.select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, violations) of rules that must not be false; null counts as a violation."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    return counted.select(F.explode(F.create_map(*[x for name in checks for x in (F.lit(name), F.col(name))])).alias("rule", "violations"))


#: What a source or document descriptor may say.
SOURCE_TYPES = ["documentation", "repository", "blog", "standard"]
DOCUMENT_STATES = ["ACTIVE", "REDIRECTED", "STALE", "REMOVED", "UNAVAILABLE"]


def source_errors() -> Column:
    rule = lambda bad, code: F.when(F.coalesce(bad, F.lit(True)), F.lit(code))
    return F.filter(F.array(
        rule(~F.col("source_key").rlike(r"^[a-z0-9](?:[a-z0-9._-]{0,126}[a-z0-9])?$"), "SOURCE_KEY_INVALID"), rule(~F.length(F.trim("display_name")).between(1, 200), "DISPLAY_NAME_INVALID"),
        rule(urls.canonical_url(F.col("base_url")).isNull(), "BASE_URL_INVALID"), rule(~F.col("source_type").isin(SOURCE_TYPES), "SOURCE_TYPE_INVALID"), rule(T.language_tag(F.col("language")).isNull(), "LANGUAGE_TAG_INVALID"),
    ), lambda e: e.isNotNull())


def document_errors() -> Column:
    rule = lambda bad, code: F.when(F.coalesce(bad, F.lit(True)), F.lit(code))
    return F.filter(F.array(
        rule(~F.length(F.trim("title")).between(1, 512), "TITLE_INVALID"), rule(~F.length("stable_key").between(1, 512) | rules.has_control(F.col("stable_key")), "STABLE_KEY_INVALID"),
        rule(urls.transport_url(F.col("url")).isNull(), "URL_INVALID"), rule(T.language_tag(F.col("language")).isNull(), "LANGUAGE_TAG_INVALID"), rule(~F.col("mime_type").rlike(r"^[a-z0-9.+-]+/[a-z0-9.+-]+$"), "MIME_TYPE_INVALID"),
    ), lambda e: e.isNotNull())


def accepted_rejected(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def cached_payload_valid(payload: Column, most: int = 50) -> Column:
    """A cached result page: an object whose results are an array of as many items as it says, each with a safe URL."""
    shape = F.from_json(payload, "returned int, results array<struct<title: string, url: string, score: double>>")
    sound = F.forall(shape["results"], lambda r: urls.canonical_url(r["url"]).isNotNull() & (F.length(r["title"]) > 0) & r["score"].between(0, 1))
    return F.coalesce((F.size(shape["results"]) == shape["returned"]) & (shape["returned"] <= most) & sound, F.lit(False))


def registry_errors(registry: DataFrame) -> DataFrame:
    """(id, error): repeated ids, base URLs that are not https, or lie outside their own domain or path."""
    base = F.col("base_url")
    counted = registry.withColumn("same_id", F.count("*").over(Window.partitionBy("id")))
    found = F.array(
        F.when(F.col("same_id") > 1, "DUPLICATE_ID"), F.when(F.coalesce(urls.scheme(base) != "https", F.lit(True)), "NOT_HTTPS"), F.when(~urls.domain_matches(urls.host(base), F.lower("domain")), "OUTSIDE_DOMAIN"),
        F.when(F.col("path_prefix").isNotNull() & ~F.startswith(urls.path(base), F.col("path_prefix")), "OUTSIDE_PATH"),
    )
    return counted.select("id", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("error")).distinct()


def fixture_valid(sources: DataFrame, documents: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: is this a usable retrieval fixture?"""
    counts = sources.agg(F.count("*").alias("sources")).join(F.broadcast(documents.agg(F.count("*").alias("documents")))).join(F.broadcast(queries.agg(F.count("*").alias("queries"))))
    grades = qrels.agg(F.count_if(~F.col("grade").between(1, 3)).alias("bad_grades"))
    return counts.join(F.broadcast(grades)).withColumn("valid", (F.col("sources") >= 10) & (F.col("documents") >= 100) & (F.col("queries") >= 50) & (F.col("bad_grades") == 0))
