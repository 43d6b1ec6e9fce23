"""Retention: by age, by count per key or overall, by bytes; table-level jobs that return what stays or goes.

Overall ranks and running totals never gather a table in one task: rows are put in ranges of the order, each
range is summed, and the prefix sums of that small table are joined to what windows within the ranges give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(at: Column, bounds: list[Column]) -> Column:
    """How many of the ascending bounds a value has reached, by halving: a row meets the logarithm of their number."""

    def within(a: int, b: int) -> Column:
        m = (a + b) // 2
        return F.lit(a) if a == b else F.when(at >= bounds[m], within(m + 1, b)).otherwise(within(a, m))

    return within(0, len(bounds))


def running(rows: DataFrame, keys: list[str], value: Column, desc: bool = False, partitions: int | None = None) -> DataFrame:
    """rows with before (the sum of value over all rows ahead in order) and rank (from 1), and the totals n and total.

    Rows are put in ranges of their keys by fixed bounds, so that the ranges are the same whenever they are computed.
    The bounds come from a sample of keys of bounded size. Give keys that make a total order for a defined answer.
    """
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fraction = min(1.0, 50 * parts / max(1, rows.count()))
    drawn = sorted({tuple(r) for r in rows.select(*keys).dropna().sample(False, fraction, 7).limit(200 * parts).collect()})
    bounds = [drawn[len(drawn) * k // parts] for k in range(1, parts)] if len(drawn) >= parts else drawn
    types = dict(rows.select(*keys).dtypes)
    literal = [F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, b, strict=True)]) for b in bounds]
    at = F.struct(*[F.col(k) for k in keys])
    place = range_of(at, literal)
    placed = rows.withColumn("_v", value).withColumn("_p", -place if desc else place)
    order = [F.col(k).desc() if desc else F.col(k) for k in keys]
    local = Window.partitionBy("_p").orderBy(*order)
    sums = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_t"))
    # One row per range: these windows are over as many rows as there are ranges.
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_on"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_ot"), F.sum("_n").over(every).alias("n"), F.sum("_t").over(every).alias("total"))
    ranked = placed.withColumn("_r", F.row_number().over(local)).withColumn("_s", F.sum("_v").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.join(F.broadcast(offsets), "_p").select(*rows.columns, (F.col("_on") + F.col("_r")).alias("rank"), (F.col("_ot") + F.col("_s") - F.col("_v")).alias("before"), "n", "total")


def keep_newest_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Versions to drop: not current, not pending, and not among the newest so many of the rest of their document."""
    others = versions.where("not is_current and not coalesce(pending_current, false)")
    newest = Window.partitionBy("document_id").orderBy(F.col("fetched_at").desc(), F.col("version_id").desc())
    return others.withColumn("k", F.row_number().over(newest)).where(F.col("k") > keep).drop("k")


def purge_counts(dropped: DataFrame, sections: DataFrame) -> DataFrame:
    """What a purge takes: documents, versions, sections."""
    v = dropped.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("versions"))
    s = sections.join(dropped.select("version_id"), "version_id", "left_semi").agg(F.count("*").alias("sections"))
    return v.join(F.broadcast(s))


def within_age(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))


def newest(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """The newest so many rows by key; overall ranks without one big window."""
    return running(rows, [key], F.lit(1), desc=True).where(F.col("rank") <= keep).select(*rows.columns)


def expired_runs(runs: DataFrame, now: Column, days: int, keep: int) -> DataFrame:
    """Ended runs older than so many days that are not among the newest so many."""
    ended = runs.where("status <> 'RUNNING'")
    kept = newest(ended.select("run_id"), "run_id", keep)
    return ended.where(F.coalesce("completed_at", "started_at") < now - F.expr(f"INTERVAL {days} DAYS")).join(kept, "run_id", "left_anti")


def detached(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Events of deleted runs lose their run."""
    mark = gone.select("run_id").distinct().withColumn("gone", F.lit(True))
    return events.join(mark, "run_id", "left").withColumn("run_id", F.when(F.col("gone").isNull(), F.col("run_id"))).select(*events.columns)


def unexpired(cache: DataFrame, now: Column, retention: str) -> DataFrame:
    return cache.where(F.col("expires_at") + F.expr(f"INTERVAL {retention}") > now)


def evicted(cache: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The least recently used rows over all kinds that must go so that rows and bytes fit."""
    placed = running(cache, ["last_accessed_at", "created_at", "kind", "cache_key"], F.col("size_bytes"))
    return placed.where((F.col("n") - F.col("rank") + 1 > most_rows) | (F.col("total") - F.col("before") > most_bytes)).select(*cache.columns)


def usage(*tables: DataFrame) -> DataFrame:
    out = None
    for t in tables:
        part = t.select("size_bytes")
        out = part if out is None else out.unionByName(part)
    return out.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def cache_put(cache: DataFrame, new: DataFrame, now: Column, ttl_seconds: Column) -> DataFrame:
    """Upsert entries (kind, cache_key, payload): sizes in UTF-8 bytes, expiry from now."""
    from .catalog import upserted

    made = new.withColumns({"created_at": now, "last_accessed_at": now, "expires_at": F.timestamp_seconds(F.unix_timestamp(now) + ttl_seconds), "size_bytes": F.octet_length("payload").cast("long")})
    return upserted(cache, made.select(*[c for c in cache.columns if c in made.columns]), ["kind", "cache_key"])
