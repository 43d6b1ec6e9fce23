"""Readers: explicit schemas, column pruning and filters left to the scan, rejects as rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators.pages import extracted

MOST_BYTES = 16 << 20
MANIFEST = "schema_version int, ord int, source_key string, display_name string, base_url string, source_type string, language string, sync_strategy string, enabled boolean, documents array<struct<stable_key: string, title: string, url: string, language: string, mime_type: string>>"
PROVIDER = "results array<struct<title: string, url: string, content: string, score: double, engine: string, engines: array<string>, publishedDate: string, language: string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.orderBy(*keys)


def lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the keys given; both sides may be large."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def text_files(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """One document per file, and the files that are too large or not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= most).select("path", "length", F.col("content").cast("string").alias("text"))
    sound = F.is_valid_utf8("text")
    rejects = files.where(F.col("length") > most).select("path", "length", F.lit("TOO_LARGE").alias("reason")).unionByName(small.where(~sound).select("path", "length", F.lit("NOT_UTF8").alias("reason")))
    return small.where(sound), rejects


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sources of manifests of version 1, and what is rejected: other versions, and keys given more than once, with the reason."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    known = F.coalesce(F.col("schema_version") == 1, F.lit(False))
    again = rows.where(known).groupBy("source_key").agg(F.count("*").alias("n")).where("n > 1").select("source_key", F.lit(True).alias("again"))
    marked = rows.join(again, "source_key", "left").withColumn("reason", F.when(~known, "SCHEMA_VERSION").when(F.col("again"), "DUPLICATE_KEY"))
    return marked.where("reason is null").select(*rows.columns), marked.where("reason is not null").select("source_key", "schema_version", "reason")


def pretty_json(x: Column) -> Column:
    """JSON with an indent of two; null where the text is none. Whole numbers are written without a point, as a browser does."""

    @F.pandas_udf("string")
    def laid_out(texts: pd.Series) -> pd.Series:
        def number(t: str) -> float | int:
            v = float(t)
            return int(v) if v.is_integer() and abs(v) < 1e21 else v

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t, parse_float=number), indent=2, ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return laid_out(x)


def crawled(resources: DataFrame) -> DataFrame:
    """(page_id, url, content_type, body) -> page_id, url, markdown by content type; other types are not here."""
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    rows = resources.withColumn("kind", kind)
    as_html = extracted(rows.where(kind.isin("text/html", "application/xhtml+xml")).select("page_id", "url", F.col("body").alias("html"))).select("page_id", "url", "markdown")
    fence = lambda name, body: F.concat(F.lit(f"```{name}\n"), body, F.lit("\n```"))
    pretty = pretty_json(F.col("body"))
    is_json, is_xml, is_yaml = kind.rlike(r"^application/(?:.+\+)?json$"), kind.rlike(r"^(?:application|text)/(?:.+\+)?xml$"), kind.rlike(r"ya?ml$")
    body = F.trim("body")
    other = F.when(is_json, fence("json", F.coalesce("pretty", body))).when(is_xml, fence("xml", body)).when(is_yaml, fence("yaml", body)).when(F.startswith(kind, F.lit("text/")) & (kind != "text/html"), body)
    told = rows.where(~kind.isin("text/html", "application/xhtml+xml"))
    told = told.where(is_json).withColumn("pretty", pretty).unionByName(told.where(~F.coalesce(is_json, F.lit(False))).withColumn("pretty", F.lit(None).cast("string")))
    rest = told.select("page_id", "url", other.alias("markdown")).where("markdown is not null")
    return as_html.unionByName(rest)


def provider_results(responses: DataFrame, first: int = 50) -> DataFrame:
    """(query_id, query, response: JSON) -> a row per result with defaults; bad dates and languages are null."""
    rows = responses.select("query_id", "query", F.posexplode(F.slice(F.from_json("response", PROVIDER)["results"], 1, first)).alias("rank", "r"))
    engines = F.coalesce("r.engines", F.when(F.col("r.engine").isNotNull(), F.array("r.engine")), F.array().cast("array<string>"))
    return rows.select(
        "query_id", "query", "rank", F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.url").alias("url"), T.clean_snippet(F.coalesce("r.content", F.lit(""))).alias("snippet"), F.col("r.score").alias("score"),
        engines.alias("engines"), rules.parsed_date(F.col("r.publishedDate")).alias("published_at"), T.language_tag(F.col("r.language")).alias("language"),
    )


def scale_corpus(topics: DataFrame, per_topic: int) -> DataFrame:
    """So many template sections per topic; the range is exploded within each topic's row."""
    n = F.explode(F.sequence(F.lit(1), F.lit(per_topic))).alias("n")
    return topics.select("source_key", "topic_id", "title", n).withColumn("content", F.format_string("%s: section %d of %s about %s.", F.col("title"), F.col("n"), F.col("source_key"), F.col("topic_id")))


def between(rows: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    return rows.where(F.col(at).between(start, end))
