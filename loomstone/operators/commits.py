"""Commits of a catalog: versions, their sections and the pointers of documents change together or not at all.

The three tables lie in a store by segment (a hash of the document), so a commit rewrites the segments of its documents
only, and one manifest publishes all. A batch number makes a replay harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import Change, Store, materialized
from .catalog import latest, versions_committed

VERSION = "document_id string, content_hash string, version_label string, published_at timestamp, etag string, last_modified string, fetched_at timestamp, is_current boolean"
SECTION = "document_id string, content_hash string, ordinal int, heading string, content string"
POINTER = "document_id string, content_hash string, fetched_at timestamp"
SEGMENTS = 16
#: Fixed value: sections that a version may have.
MOST_SECTIONS = 1024


def _part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("segment", F.pmod(F.xxhash64("document_id"), F.lit(SEGMENTS)).cast("int"))


def read(store: Store, name: str, segments: list | None = None) -> DataFrame:
    """versions, sections or pointers as last committed; empty before the first commit."""
    if name not in store.manifest()["tables"]:
        return store.spark.createDataFrame([], {"versions": VERSION, "sections": SECTION, "pointers": POINTER}[name])
    return store.read(name, segments).drop("segment")


def committable(observed: DataFrame, sections: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed versions that may be committed, and the others with a reason.

    A version needs sections, 1 to 1,024: new ones, or those that it has from an earlier commit (known: document_id, content_hash).
    Of several observations of a document the latest counts.
    """
    new = latest(observed, ["document_id"], [F.col("fetched_at"), F.col("content_hash")])
    given = sections.groupBy("document_id", "content_hash").agg(F.count("*").alias("_n"))
    have = known.select("document_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    marked = new.join(given, ["document_id", "content_hash"], "left").join(have, ["document_id", "content_hash"], "left")
    reason = F.when(F.col("_n") > MOST_SECTIONS, "TOO_MANY_SECTIONS").when(F.col("_n").isNull() & F.col("_known").isNull(), "NO_SECTIONS")
    marked = materialized(marked.withColumn("reason", reason), "observed")
    return marked.where("reason is null").select(*observed.columns), marked.where("reason is not null").select("document_id", "content_hash", "reason")


def committed(versions: DataFrame, sections: DataFrame, pointers: DataFrame, observed: DataFrame, new_sections: DataFrame) -> dict[str, DataFrame]:
    """The three tables after a commit of versions that may be committed; sections of a version given again replace what it had."""
    after = materialized(versions_committed(versions, observed), "versions")
    key = ["document_id", "content_hash"]
    given = new_sections.join(observed.select(*key).distinct(), key, "left_semi")
    kept = sections.join(given.select(*key).distinct(), key, "left_anti")
    now = after.where("is_current").select("document_id", "content_hash", "fetched_at")
    return {"versions": after, "sections": kept.unionByName(given), "pointers": pointers.join(now.select("document_id"), "document_id", "left_anti").unionByName(now)}


def commit(store: Store, observed: DataFrame, sections: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame | None:
    """Commit observed versions (document_id, content_hash, version_label, published_at, etag, last_modified, fetched_at) with their sections.

    Returns what was turned down (document_id, content_hash, reason); None where the batch was committed before.
    """
    if batch and store.manifest()["batches"].get(batch[0], -1) >= batch[1]:
        return None
    hit = sorted(r[0] for r in _part(observed.select("document_id").distinct()).select("segment").distinct().collect())  # at most SEGMENTS
    old = {name: read(store, name, hit) for name in ("versions", "sections", "pointers")}
    good, turned_down = committable(observed, sections, old["sections"])
    new = committed(*old.values(), good, sections)
    store.commit({name: Change(_part(rows).repartition("segment"), "segment", hit) for name, rows in new.items()}, batch)
    return turned_down


def current_sections(spark: SparkSession, base: str) -> DataFrame:
    """Sections of the versions that pointers name, as of one manifest."""
    store = Store(spark, base)
    return read(store, "sections").join(read(store, "pointers").select("document_id", "content_hash"), ["document_id", "content_hash"], "left_semi")


def section_counts(store: Store) -> DataFrame:
    """(document_id, content_hash, is_current, sections) of all versions."""
    n = read(store, "sections").groupBy("document_id", "content_hash").agg(F.count("*").alias("sections"))
    return read(store, "versions").join(n, ["document_id", "content_hash"], "left").select("document_id", "content_hash", "is_current", F.coalesce("sections", F.lit(0)).cast("long").alias("sections"))


# --- history --------------------------------------------------------------------------------------


def append_history(store: Store, rows: DataFrame, days: int, batch: tuple[str, int] | None = None) -> bool:
    """Append history (request_id, executed_at, ...) to a table by day; what is older than so many days before the newest row goes.

    Days that are past as a whole are dropped by name, the day of the limit is written anew, and only files of the days that
    the batch has are added to. A request_id that the table holds within the limit is not taken again; of several rows of one in a batch the earliest counts.
    """
    by_day = lambda d: d.withColumn("day", F.date_format("executed_at", "yyyy-MM-dd"))
    rest = [c for c in rows.columns if c != "request_id"]
    one = rows.groupBy("request_id").agg(F.min_by(F.struct(*rest), F.struct("executed_at", *[c for c in rest if c != "executed_at"])).alias("r")).select("request_id", "r.*").select(*rows.columns)
    told = store.manifest()["tables"]
    held = store.read("history") if "history" in told else by_day(one).limit(0)
    newest = [d.agg(F.max("executed_at")).first()[0] for d in (held, one)]
    if newest[1] is None or batch and store.manifest()["batches"].get(batch[0], -1) >= batch[1]:
        return False
    limit = F.lit(max(n for n in newest if n is not None)) - F.expr(f"INTERVAL {days} DAYS")
    first = store.spark.range(1).select(F.date_format(limit, "yyyy-MM-dd")).first()[0]
    fresh = by_day(one.where(F.col("executed_at") >= limit).join(held.where(F.col("executed_at") >= limit).select("request_id"), "request_id", "left_anti"))
    past = [p for p in store.parts("history") if p <= first]
    edge = store.read("history", [first]).where(F.col("executed_at") >= limit) if first in past else None
    changes = [Change(edge, "day", past), Change(materialized(fresh, "history").select(*by_day(rows).columns), "day", add=True)]
    return store.commit({"history": changes}, batch)

