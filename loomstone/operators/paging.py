"""Pages of results: by offset, by key, by a budget of characters, and whole tables cut into page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retention import running

MOST = 50


def like_pattern(x: Column) -> Column:
    """A substring pattern for LIKE ... ESCAPE '!'."""
    return F.concat(F.lit("%"), F.regexp_replace(F.lower(x), r"([!%_])", "!$1"), F.lit("%"))


def document_filter(source_key: str | None = None, language: str | None = None, status: str | None = None) -> Column:
    """A conjunction of the filters that are given."""
    out = F.lit(True)
    out = out if source_key is None else out & (F.col("source_key") == source_key)
    out = out if language is None else out & (F.lower("language") == language.lower())
    return out if status is None else out & (F.col("status") == status)


def offset_page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(key).offset(offset).limit(max(1, min(limit, MOST)))


def next_offset(total: int, offset: int, limit: int) -> int | None:
    return offset + limit if offset + limit < total else None


def key_page(rows: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """The newest rows before a key, with next_before (the key to go on from, on all rows; null on the last page) and total.

    total counts all rows, whatever the key. One row more than asked for is looked at, and tells whether there is a next page.
    """
    total = rows.agg(F.count("*").alias("total"))
    page = (rows if before is None else rows.where(F.col(key) < before)).orderBy(F.col(key).desc()).limit(limit + 1)
    every = Window.partitionBy()  # at most limit + 1 rows
    page = page.withColumns({"_n": F.row_number().over(Window.orderBy(F.col(key).desc())), "_more": F.count("*").over(every) > limit}).where(F.col("_n") <= limit)
    last = F.when(F.col("_more"), F.min(key).over(every)).alias("next_before")
    return page.select(*rows.columns, last).join(F.broadcast(total))


def key_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Every row with its page (from 0, newest key first), next_before (null on the last page) and total: what key_page gives, page after page."""
    ranked = running(rows, [key], F.lit(1), desc=True)
    page = F.floor((F.col("rank") - 1) / size).cast("long")
    numbered = ranked.select(*rows.columns, page.alias("page"), F.col("n").alias("total"))
    last = numbered.groupBy("page").agg(F.min(key).alias("_last"))
    out = numbered.join(last, "page")
    return out.select(*rows.columns, "page", F.when((F.col("page") + 1) * size < F.col("total"), F.col("_last")).alias("next_before"), "total")


def paged(rows: DataFrame, key: str, size: int = 20) -> DataFrame:
    """Every row with its page number, in order of key, without one big window."""
    return running(rows, [key], F.lit(1)).select(*rows.columns, F.floor((F.col("rank") - 1) / size).cast("long").alias("page_id"))


def within_budget(rows: DataFrame, group: list[str], order: list[Column], budget: int = 20_000) -> DataFrame:
    """The longest prefix of each group whose JSON, with separators, fits; a first row that is too long is kept and marked."""
    w = Window.partitionBy(*group).orderBy(*order)
    size = F.length(F.to_json(F.struct(*rows.columns))) + 1
    out = rows.withColumn("_size", size).withColumn("used", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(w))
    return out.where((F.col("used") <= budget) | (F.col("_n") == 1)).select(*rows.columns, "used", (F.col("used") > budget).alias("too_long"))


def read_sections(ids: DataFrame, sections: DataFrame, most: int = 3000) -> DataFrame:
    """Sections by id, cut to 200..8,000 characters; an unknown id gives an empty row."""
    most = max(200, min(most, 8000))
    s = sections.select("section_id", "content", F.lit(True).alias("known"))
    return ids.join(s, "section_id", "left").select("section_id", F.coalesce("known", F.lit(False)).alias("found"), T.truncate_ellipsis(F.coalesce("content", F.lit("")), most).alias("content"), (F.length(F.coalesce("content", F.lit(""))) > most).alias("truncated"))


def exported(rows: DataFrame, key: str, path: str, size: int = 20, budget: int = 24_000, text_limit: int = 8_000) -> None:
    """JSON page files: so many rows a page, texts cut, contentTruncated set, and no page over its budget."""
    cut = rows.withColumn("contentTruncated", F.length("content") > text_limit).withColumn("content", T.truncate_ellipsis(F.col("content"), text_limit))
    pages = within_budget(paged(cut, key, size), ["page_id"], [F.col(key)], budget).drop("used", "too_long")
    pages.repartition("page_id").sortWithinPartitions("page_id", key).write.partitionBy("page_id").json(path)


def history_page(history: DataFrame, text: str | None = None, tool: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """History rows that match every filter given; times are inclusive at both ends."""
    if start is not None and end is not None and start > end:
        raise ValueError("the time range ends before it begins")
    out = history
    out = out if text is None else out.where(F.instr(F.lower("query"), text.lower()) > 0)
    out = out if tool is None else out.where(F.col("tool") == tool)
    out = out if status is None else out.where(F.col("status") == status)
    out = out if start is None else out.where(F.col("executed_at") >= F.lit(start).cast("timestamp"))
    return out if end is None else out.where(F.col("executed_at") <= F.lit(end).cast("timestamp"))
