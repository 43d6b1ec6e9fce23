"""Catalog maintenance as set operations: snapshots in, observations in, new snapshots out.

A snapshot is rewritten by one full outer join on its key; there is no per-document loop. Of several
observations of a document the latest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions import text as T

SOURCE_FIELDS = ["display_name", "base_url", "source_type", "language", "freshness_policy", "sync_strategy", "enabled"]


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by order; max_by aggregates before it shuffles, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """The snapshot after an upsert: new rows win, but columns in keep stay as they were first written."""
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    fresh = F.col("b._new").isNotNull()

    def column(c: str) -> Column:
        if c in key or c in keep:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in new.columns else F.col(f"a.{c}")
        return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")

    return joined.select(*[column(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key that new has are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def aliases_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, url): first seen is kept, last seen and the latest type win."""
    both = old.unionByName(new)
    return both.groupBy("document_id", "url").agg(F.max_by("alias_type", "last_seen_at").alias("alias_type"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Nested sources with documents -> a row per document with defaults and its place in manifest order."""
    sources = manifest.select(
        F.col("ord").alias("source_ord"), "source_key", F.coalesce("language", F.lit("fr")).alias("language"), F.coalesce("source_type", F.lit("documentation")).alias("source_type"),
        F.coalesce("sync_strategy", F.lit("manual")).alias("sync_strategy"), F.coalesce("enabled", F.lit(True)).alias("enabled"), "documents",
    )
    rows = sources.select(*[c for c in sources.columns if c != "documents"], F.posexplode("documents").alias("document_ord", "d"))
    return rows.select("source_ord", "document_ord", "source_key", "source_type", "sync_strategy", "enabled", "d.stable_key", "d.title", "d.url", F.coalesce("d.language", "language").alias("language"), F.coalesce("d.mime_type", F.lit("text/html")).alias("mime_type"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def reconciled(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_key) -> created, updated or skipped, by the fields that are compared."""
    a, b = old.alias("a"), wanted.alias("b")
    same = F.lit(True)
    for c in SOURCE_FIELDS:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    status = F.when(F.col("a.source_key").isNull(), "created").when(same, "skipped").otherwise("updated")
    return b.join(a, F.col("a.source_key") == F.col("b.source_key"), "left").select(F.col("b.source_key").alias("source_key"), status.alias("status"))


def sync_plan(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """What a run would do, per source: planned or skipped documents, configured and current numbers."""
    now = documents.groupBy("source_key").agg(F.count("*").alias("current"))
    return (
        manifest.groupBy("source_key", "enabled").agg(F.count("*").alias("configured")).join(now, "source_key", "left")
        .select("source_key", "configured", F.coalesce("current", F.lit(0)).alias("current"), F.when(F.col("enabled"), F.col("configured")).otherwise(0).alias("planned"), F.when(F.col("enabled"), 0).otherwise(F.col("configured")).alias("skipped"), F.when(~F.col("enabled"), F.lit("DISABLED")).alias("reason"))
    )


def document_plan(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """What a run would do with each configured document: planned, or skipped with a reason.

    manifest: source_key, stable_key, title, url, language, mime_type, enabled; sources: source_key, enabled. A document of an unknown
    source is not planned, nor is one that is disabled itself or by its source.
    """
    s = sources.select("source_key", F.col("enabled").alias("_source"))
    joined = manifest.join(s, "source_key", "left")
    reason = F.when(F.col("_source").isNull(), "SOURCE_NOT_FOUND").when(~F.coalesce("enabled", F.lit(True)) | ~F.col("_source"), "DISABLED")
    return joined.select(*manifest.columns, F.when(reason.isNull(), "planned").otherwise("skipped").alias("status"), reason.alias("reason"))


def manifest_fingerprint(manifest: DataFrame) -> str:
    """The same for the same enabled documents in the same order, however the rows lie; made of sums, without a sort."""
    row = [c for c in ("source_ord", "document_ord", "source_key", "stable_key", "url") if c in manifest.columns]
    h = [F.xxhash64(F.lit(k), *row) for k in range(4)]
    r = manifest.where("enabled").agg(F.count("*").alias("n"), *[F.coalesce(F.bit_xor(x), F.lit(0)).alias(f"x{k}") for k, x in enumerate(h)], F.coalesce(F.sum(F.pmod(h[0], F.lit(1 << 32))), F.lit(0)).alias("s"))
    return r.select(F.sha2(F.concat_ws(":", "n", "x0", "x1", "x2", "x3", "s"), 256)).first()[0]


def execution_slice(manifest: DataFrame, source: str | None = None, after: tuple[str, str] | None = None, limit: int | None = None, fingerprint: str | None = None) -> DataFrame:
    """The enabled documents to take next, in manifest order, strictly after a (source, key).

    Each row has next_source and next_key, the cursor for the next call: the last row of the slice, null where nothing is left behind it. A
    fingerprint (of manifest_fingerprint) that no longer fits is an error, since the cursor was of another manifest, and so is a cursor that it does not have.
    """
    if fingerprint is not None and fingerprint != manifest_fingerprint(manifest):
        raise ValueError("the manifest has changed since the cursor was made")
    rows = manifest.where("enabled") if source is None else manifest.where("enabled").where(F.col("source_key") == source)
    place = F.struct("source_ord", "document_ord")
    if after is not None:
        at = manifest.where((F.col("source_key") == after[0]) & (F.col("stable_key") == after[1])).agg(F.max(place).alias("cursor"))
        if at.first()["cursor"] is None:
            raise ValueError("the manifest does not have the document of the cursor")
        rows = rows.join(F.broadcast(at), place > F.col("cursor")).drop("cursor")
    cut = rows.orderBy("source_ord", "document_ord").limit(limit + 1) if limit is not None else rows
    if limit is None:
        return cut.withColumns({"next_source": F.lit(None).cast("string"), "next_key": F.lit(None).cast("string")}).orderBy("source_ord", "document_ord")
    order, every = Window.orderBy("source_ord", "document_ord"), Window.partitionBy()  # at most limit + 1 rows
    numbered = cut.withColumns({"_n": F.row_number().over(order), "_more": F.count("*").over(every) > limit}).where(F.col("_n") <= limit)
    last = F.when(F.col("_more"), F.max(F.struct("_n", "source_key", "stable_key")).over(every))
    return numbered.withColumn("_last", last).select(*manifest.columns, F.col("_last.source_key").alias("next_source"), F.col("_last.stable_key").alias("next_key")).orderBy("source_ord", "document_ord")


def outcomes(manifest: DataFrame, log: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Each observation against its source and the known document: outcome, next status, events' causes."""
    doc = documents.select("source_key", "stable_key", "document_id", F.col("status").alias("old_status"), F.col("content_hash").alias("old_hash"), F.col("canonical_url").alias("old_url"))
    src = sources.select("source_key", F.col("enabled").alias("source_enabled"))
    rows = log.join(manifest.select("source_key", "stable_key"), ["source_key", "stable_key"], "left_semi").join(src, "source_key", "left").join(doc, ["source_key", "stable_key"], "left")
    kind, known = rules.http_class(F.col("http_status")), F.col("document_id").isNotNull()
    outcome = (
        F.when(F.col("source_enabled").isNull(), "skipped:SOURCE_NOT_FOUND").when(~F.col("source_enabled"), "skipped:SOURCE_DISABLED")
        .when(known & (kind == "missing"), "updated").when(F.col("error_code").isNotNull() | kind.isin("missing", "transient", "error"), "failed")
        .when(~known, "added").when((kind == "not_modified") | (F.col("old_hash") == F.col("content_hash")), "unchanged").otherwise("updated")
    )
    target = rules.permanent_target(F.col("redirects"))
    status = F.when(F.col("http_status") == 404, "STALE").when(F.col("http_status") == 410, "REMOVED").when(outcome == "failed", F.col("old_status")).when(target.isNotNull(), "REDIRECTED").otherwise("ACTIVE")
    return rows.withColumns({"outcome": outcome, "new_status": status, "permanent_target": urls.canonical_url(target), "transient": (kind == "transient") | F.col("error_code").isin("PROVIDER_UNAVAILABLE", "REQUEST_TIMEOUT")})


def events(found: DataFrame) -> DataFrame:
    """Staleness events of outcomes, with JSON details."""
    live = found.where(~F.startswith("outcome", F.lit("skipped")))
    known = F.col("document_id").isNotNull()
    canonical = urls.canonical_url(F.col("canonical_url"))
    one = lambda cond, name, **details: F.when(cond, F.struct(F.lit(name).alias("event_type"), F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])).alias("details_json")))
    made = F.array(
        one(F.col("permanent_target").isNotNull(), "PERMANENT_REDIRECT", to=F.col("permanent_target")),
        one(known & canonical.isNotNull() & (canonical != F.col("old_url")), "CANONICAL_CHANGED", before=F.col("old_url"), after=canonical),
        one(known & (F.col("outcome") == "updated") & (F.col("content_hash") != F.col("old_hash")), "CONTENT_HASH_CHANGED", before=F.col("old_hash"), after=F.col("content_hash")),
        one(known & (F.col("http_status") == 404), "HTTP_404", status=F.col("http_status")), one(known & (F.col("http_status") == 410), "HTTP_410", status=F.col("http_status")),
        one(known & F.coalesce("transient", F.lit(False)), "SOURCE_UNAVAILABLE", status=F.col("http_status"), error=F.col("error_code")),
    )
    return live.select("document_id", "run_id", F.col("fetched_at").alias("observed_at"), F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("document_id", "run_id", "e.event_type", "observed_at", "e.details_json")


def valid_events(rows: DataFrame) -> DataFrame:
    """Events whose details are a JSON object."""
    return rows.where(F.startswith(F.trim("details_json"), F.lit("{")) & F.try_parse_json("details_json").isNotNull())


def alias_rows(found: DataFrame) -> DataFrame:
    """Other URLs of a document: REDIRECT beats OLD_URL beats CANONICAL; its canonical URL itself is none."""
    canonical = urls.canonical_url(F.coalesce("canonical_url", "final_url"))
    hops = F.transform(rules.permanent_prefix(F.coalesce("redirects", F.array().cast("array<struct<from_url:string,to_url:string,status:int,permanent:boolean>>"))), lambda h: F.struct(h["from_url"].alias("url"), F.lit("REDIRECT").alias("alias_type"), F.lit(3).alias("p")))
    given = F.concat(hops, F.array(F.struct(F.col("old_url").alias("url"), F.lit("OLD_URL").alias("alias_type"), F.lit(2).alias("p")), F.struct(F.col("canonical_url").alias("url"), F.lit("CANONICAL").alias("alias_type"), F.lit(1).alias("p"))))
    rows = found.select("source_key", "stable_key", canonical.alias("canonical"), F.explode(given).alias("a")).select("source_key", "stable_key", "canonical", urls.canonical_url(F.col("a.url")).alias("url"), "a.alias_type", "a.p")
    return rows.where("url is not null and not (url <=> canonical)").groupBy("source_key", "stable_key", "url").agg(F.max_by("alias_type", "p").alias("alias_type"))


def versions_committed(versions: DataFrame, observed: DataFrame) -> DataFrame:
    """Version snapshot after observations (document_id, content_hash, fetched_at, version_label, published_at, etag, last_modified).

    A hash seen before keeps its label, publication and first validators where none is new; the latest hash of each
    document is current, also when it is an old one; documents without observation stay as they are.
    """
    new = latest(observed, ["document_id"], [F.col("fetched_at"), F.col("content_hash")])
    a, b = versions.alias("a"), new.alias("b")
    same = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.content_hash") == F.col("b.content_hash"))
    kept = a.join(b, same, "full_outer").select(
        F.coalesce("a.document_id", "b.document_id").alias("document_id"), F.coalesce("a.content_hash", "b.content_hash").alias("content_hash"),
        F.coalesce("a.version_label", "b.version_label", F.date_format("b.fetched_at", "yyyy-MM-dd")).alias("version_label"), F.coalesce("a.published_at", "b.published_at", "b.fetched_at").alias("published_at"),
        F.coalesce("b.etag", "a.etag").alias("etag"), F.coalesce("b.last_modified", "a.last_modified").alias("last_modified"), F.greatest("a.fetched_at", "b.fetched_at").alias("fetched_at"),
        F.col("a.is_current").alias("was_current"), F.col("b.document_id").isNotNull().alias("seen"),
    )
    touched = new.select("document_id").withColumn("touched", F.lit(True))
    return kept.join(touched, "document_id", "left").select(
        "document_id", "content_hash", "version_label", "published_at", "etag", "last_modified", "fetched_at",
        F.when(F.col("touched").isNull(), F.coalesce("was_current", F.lit(False))).otherwise(F.col("seen")).alias("is_current"),
    )


def promoted(staged: DataFrame, sections: DataFrame, most: int = 1024) -> DataFrame:
    """Pending versions whose sections have arrived (1 to so many) become current; others stay pending."""
    ready = sections.groupBy("version_id").agg(F.count("*").alias("n")).where(F.col("n").between(1, most)).select("version_id", F.lit(True).alias("ready"))
    joined = staged.join(ready, "version_id", "left")
    go = F.coalesce("ready", F.lit(False)) & F.col("pending_current")
    any_go = F.max(go.cast("int")).over(Window.partitionBy("document_id")) == 1
    return joined.withColumn("is_current", F.when(any_go, go).otherwise(F.col("is_current"))).withColumn("pending_current", F.col("pending_current") & ~go).drop("ready")


def refreshed_validators(versions: DataFrame, answers: DataFrame) -> DataFrame:
    """304 answers (document_id, etag, last_modified, fetched_at) refresh the current version's validators."""
    new = latest(answers, ["document_id"], [F.col("fetched_at")]).select("document_id", F.col("etag").alias("e"), F.col("last_modified").alias("m"), F.col("fetched_at").alias("f"))
    on = F.col("is_current")
    return versions.join(new, "document_id", "left").withColumns({
        "etag": F.when(on, F.coalesce("e", "etag")).otherwise(F.col("etag")), "last_modified": F.when(on, F.coalesce("m", "last_modified")).otherwise(F.col("last_modified")),
        "fetched_at": F.when(on, F.greatest("f", "fetched_at")).otherwise(F.col("fetched_at")),
    }).select(*versions.columns)


def touched(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """last_seen_at of observed documents."""
    new = seen.groupBy("document_id").agg(F.max("observed_at").alias("at"))
    return documents.join(new, "document_id", "left").withColumn("last_seen_at", F.greatest("last_seen_at", "at")).select(*documents.columns)


def merged_not_modified(cached: DataFrame, answers: DataFrame) -> DataFrame:
    """A cached page with the redirects and validators of a 304 answer."""
    a, b = cached.alias("a"), answers.alias("b")
    fresh = {"final_url", "etag", "last_modified", "redirects", "metadata"}
    columns = [F.coalesce(F.map_concat(F.map_filter("a.metadata", lambda k, _: ~F.array_contains(F.map_keys(F.col("b.metadata")), k)), "b.metadata"), F.col("a.metadata")).alias(c) if c == "metadata" else F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in fresh else F.col(f"a.{c}").alias(c) for c in cached.columns]
    return a.join(b, F.col("a.url") == F.col("b.url"), "left").select(*columns)


def run_status(found: DataFrame) -> DataFrame:
    """Counters and the final status of each run."""
    counts = found.groupBy("run_id").agg(F.count_if(~F.startswith("outcome", F.lit("skipped"))).alias("checked"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "unchanged", "failed")])
    return counts.withColumn("status", F.when(F.col("failed") == 0, "SUCCESS").when(F.col("failed") == F.col("checked"), "FAILED").otherwise("PARTIAL"))


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Running runs that must give way: the newest global run beats all; without one, the newest of each source survives."""
    live = runs.where("status = 'RUNNING'")
    newest = live.agg(F.max(F.when(F.col("source_id").isNull(), F.struct("started_at", "run_id"))).alias("g"))
    rows = live.join(F.broadcast(newest)).withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())))
    loses = F.when(F.col("g").isNotNull(), F.col("run_id") != F.col("g.run_id")).otherwise(F.col("n") > 1)
    return rows.where(loses).select("run_id", "source_id", F.lit("FAILED").alias("status"))


def changed_source_documents(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of sources whose attributes changed: what is to be indexed anew."""
    moved = reconciled(old, new).where("status = 'updated'").select("source_key")
    return documents.join(moved, "source_key", "left_semi")


def current_sections(sections: DataFrame, versions: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Sections of the version that flag and pointer agree on."""
    live = versions.where("is_current").select("version_id", "document_id")
    docs = documents.select("document_id", F.col("current_version_id").alias("version_id"), "source_key", "title", F.col("language"), "status")
    return sections.join(live, "version_id").join(docs, ["document_id", "version_id"]).join(sources.select("source_key", "enabled"), "source_key").orderBy("source_key", F.lower("title"), "ordinal")


def searchable(rows: DataFrame) -> DataFrame:
    return rows.where("enabled and status = 'ACTIVE'")


def with_public_ids(documents: DataFrame) -> DataFrame:
    return documents.withColumn("public_id", T.public_id(F.col("source_key"), F.col("stable_key")))
