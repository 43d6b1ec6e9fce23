"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> docs.

Each works on all rows its predecessor kept and, but for the last, returns the columns of documents. Null and
empty texts pass the filters (an empty text is a copy of any other); rows that repeat a doc_id are kept or
removed together; an empty table stays empty; extra columns are kept by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, pii, simhash, toxicity
from .base import table
from .queries import KEY


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from the labels of all documents given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8)."""
    found = simhash.similar_components(docs.where("doc_id is not null"))
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms; n_chars follows the new text."""
    out = pii.pseudonymized(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("row_key")


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]
