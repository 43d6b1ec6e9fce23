"""Second-stage retrieval: hashed lexical vectors, rerank, dense top-k, rank fusion, section selection."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sections import headings, lines_of

DIMENSIONS = 64
#: Weights of features and of the two scores.
TOKEN, STEM, PAIR = 1.0, 0.6, 0.75
LEXICAL, RERANK = 0.65, 0.35
FUSION_K, FUSION_DEPTH = 60, 40
#: Vectors and queries of a block.
VECTORS, ASKED = 8192, 1024


def hashed_vector(x: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<double>: signed hashed tokens, stems and pairs, of length one (a text without tokens: zeros).

    Tokens are Spark's own expression; each distinct token is stemmed once, and features are hashed and summed, in Arrow
    batches, since a fold that rebuilds an array per feature costs the square of the text.
    """

    @F.pandas_udf("array<double>")
    def summed(tokens: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        stems: dict[str, str] = {}
        endings = [(re.compile(a), b) for a, b in T.SUFFIXES]

        def stem(t: str) -> str:
            s = stems.get(t)
            if s is None:
                s = t
                for ending, new in endings:
                    s = ending.sub(new, s)
                stems[t] = s
            return s

        def place(f: str) -> int:
            h = known.get(f)
            if h is None:
                h = 2166136261
                for c in f:
                    h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
                known[f] = h
            return h

        out = []
        for ts in tokens:
            ts = [] if ts is None else list(ts)
            ss = [stem(t) for t in ts]
            hashes = np.array([place(f) for f in [*ts, *ss, *(f"{a} {b}" for a, b in zip(ts, ts[1:]))]], np.int64)
            weights = np.repeat([TOKEN, STEM, PAIR], [len(ts), len(ss), max(0, len(ts) - 1)])
            v = np.bincount(hashes % dimensions, np.where(hashes % 2 == 0, weights, -weights), dimensions) if len(hashes) else np.zeros(dimensions)
            norm = float(np.sqrt((v * v).sum()))
            out.append(v / norm if norm else v)
            if len(known) > 200_000:
                known.clear()
                stems.clear()
        return pd.Series(out)

    return summed(T.feature_tokens(x))


def dot(a: Column, b: Column) -> Column:
    """The inner product of equally long arrays; null where the lengths differ."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), both)


def reranked(hits: DataFrame, limit: int = 10, candidates: int | None = None) -> DataFrame:
    """hits (query_id, query, position, score = tier, title, heading, heading_path, snippet, content) in combined order.

    The order is that of the score to 8 digits, then of position, so that equal texts tie whatever the order of summing.
    """
    most = min(50, max(candidates or 4 * limit, limit))
    # Texts become scores first, so that the windows need not carry them.
    lexical = F.col("score") / F.greatest(F.lit(1), F.max("score").over(Window.partitionBy("query_id")))
    texts = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "heading", "heading_path", "snippet", "content")])
    near = F.greatest(F.lit(0.0), dot(hashed_vector(F.col("query")), hashed_vector(texts)))
    scored = hits.where(F.col("position") <= most).withColumn("rerank", near).withColumn("lexical", lexical)
    scored = scored.withColumn("combined", LEXICAL * F.col("lexical") + RERANK * F.col("rerank"))
    best = Window.partitionBy("query_id").orderBy(F.round("combined", 8).desc(), F.col("position"))
    return scored.withColumn("new_position", F.row_number().over(best)).where(F.col("new_position") <= limit)


def sound_vector(e: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    return F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = VECTORS, query_block: int = ASKED) -> DataFrame:
    """(query_id, embedding) against (vec_id, embedding): the k largest inner products per query, ties by vec_id.

    Both sides are dealt to blocks of a bounded number of rows, each pair of blocks is one group of a cogroup and
    keeps k rows a query, and those are ranked; the vectors are scanned once, and nothing passes through the driver. Vectors meet
    queries of their own length only; a vector or query that is null, empty, or holds null or non-finite entries takes no part; an
    empty table on either side gives an empty result. Ids may be of any type that sorts, and stay as they are.
    """
    kind, held = (dict(d.dtypes)[c] for d, c in ((queries, "query_id"), (vectors, "vec_id")))
    x = F.col("embedding").cast("array<double>")
    asked = queries.select("query_id", x.alias("x")).where(sound_vector(F.col("x")))
    rows = vectors.select("vec_id", x.alias("y")).where(sound_vector(F.col("y")))
    groups, lanes = (max(1, -(-n // size)) for n, size in ((queries.count(), query_block), (vectors.count(), block)))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "x", F.size("x").alias("q_width"), deal(groups, "query_id", "x").alias("q_g")).withColumn("q_l", every(lanes))
    right = rows.select("vec_id", "y", F.size("y").alias("width"), deal(lanes, "vec_id", "y").alias("l")).withColumn("g", every(groups))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.take(pc.sort_indices(v, [("vec_id", "ascending")])) if v.num_rows else v
        at, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if q.num_rows and v.num_rows:
            s = matrix(q.column("x")) @ matrix(v.column("y")).T
            n = min(k, s.shape[1])
            least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            at, row = np.nonzero(s >= least[:, None])
            score = s[at, row]
            order = np.lexsort((row, -score, at))
            first = np.searchsorted(at, np.arange(len(s)))  # at is in order, and so is at[order]
            order = order[np.arange(len(order)) - first[at] < k]
            at, row, score = at[order], row[order], score[order]
        return pa.table([q.column("query_id").take(pa.array(at)), v.column("vec_id").take(pa.array(row)), pa.array(score)], names=["query_id", "vec_id", "similarity"])

    met = left.groupBy("q_g", "q_l", "q_width").cogroup(right.groupBy("g", "l", "width")).applyInArrow(best, f"query_id {kind}, vec_id {held}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id"))
    return met.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def fused(rankings: list[DataFrame], item: str = "section_id", k: int = FUSION_K, depth: int = FUSION_DEPTH, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, item, position)."""
    every = None
    for r in rankings:
        part = r.where(F.col("position") <= depth).select("query_id", item, "position")
        every = part if every is None else every.unionByName(part)
    scored = every.groupBy("query_id", item).agg(F.sum(1 / (k + F.col("position"))).alias("fused"))
    best = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), F.col(item))
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)


def section_score(heading: Column, body: Column, terms: Column) -> Column:
    """The share of a query's terms that a section has; headings, versions and code count extra."""
    tokens, head = T.content_tokens(F.concat_ws(" ", heading, body), 2048), T.content_tokens(heading, 64)
    each = F.transform(
        F.array_intersect(F.array_distinct(terms), tokens),
        lambda t: 1.0 + F.when(F.array_contains(head, t), 0.5).otherwise(0.0) + F.when(t.rlike(r"^v?\d+(?:\.\d+)+$"), 0.25).otherwise(0.0),
    )
    matched = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    raw = F.when(matched > 0, matched + F.when(body.rlike(r"(?s)```.*?```"), 0.1).otherwise(0.0)).otherwise(0.0)
    return F.least(F.lit(1.0), raw / F.greatest(F.lit(1.0), F.size(F.array_distinct(terms)) * 1.75 + 0.1))


def selected(pages: DataFrame, queries: DataFrame, budget: int, most: int, cap: int = 5000) -> DataFrame:
    """(page_id, markdown) x (page_id, query_id, query): the sections of each page that answer each query, within a budget.

    Output per (page_id, query_id): sections array<struct<heading, text, score, truncated>>, text, truncated, section_truncated, none_relevant.
    A query without terms takes the first sections.
    """
    text = T.normal_markdown(F.col("markdown"))
    read = pages.select("page_id", text.alias("text")).withColumn("lines", lines_of(F.col("text"))).withColumn("heads", headings(F.col("text"), F.col("lines")))
    body = lambda a, b: T.trimmed(F.array_join(F.slice(F.col("lines"), a, b), "\n"))
    following = lambda i: F.coalesce(F.try_element_at(F.col("heads"), i + 2)["line"], F.size("lines"))
    made = F.transform("heads", lambda h, i: F.struct(h["title"].alias("heading"), h["level"].alias("level"), body(h["line"] + 2, following(i) - h["line"] - 1).alias("body")))
    first = F.when(F.size("heads") > 0, F.col("heads")[0]["line"])
    lead = F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), F.when(first.isNull(), F.col("text")).otherwise(body(F.lit(1), first)).alias("body"))
    parts = F.filter(F.concat(F.array(lead), made), lambda s: (s["level"] > 0) | (s["body"] != ""))
    asked = read.select("page_id", parts.alias("parts")).join(queries, "page_id").withColumn("terms", T.content_tokens(F.coalesce("query", F.lit("")), 64))
    shown = lambda s: F.concat_ws("\n\n", F.when(s["level"] > 0, F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["heading"])), F.nullif(s["body"], F.lit("")))
    ranked = F.transform("parts", lambda s, i: F.struct(
        (-F.when(F.size("terms") == 0, 1.0 / (i + 1)).otherwise(section_score(s["heading"], s["body"], F.col("terms")))).alias("order"), i.alias("i"), s["heading"].alias("heading"), shown(s).alias("text")))
    kept = F.array_sort(F.filter(ranked, lambda s: s["order"] < 0))
    none = F.array().cast("array<struct<heading: string, text: string, score: double, truncated: boolean>>")
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("stopped"), none.alias("out"))

    def fold(a: Column, s: Column) -> Column:
        left = a["left"] - F.when(F.size(a["out"]) > 0, 2).otherwise(0)
        allowed = F.least(F.lit(cap), left)
        cut = F.length(s["text"]) > allowed
        value = F.when(cut, T.cut_at_boundary(s["text"], allowed)).otherwise(s["text"])
        taken = F.concat(a["out"], F.array(F.struct(s["heading"].alias("heading"), value.alias("text"), F.round(-s["order"], 6).alias("score"), cut.alias("truncated"))))
        stop = a["stopped"] | (left <= 0)
        return F.struct(F.when(stop, left).otherwise(left - F.length(value)).cast("int").alias("left"), stop.alias("stopped"), F.when(stop, a["out"]).otherwise(taken).alias("out"))

    folded = asked.withColumn("kept", kept).withColumn("f", F.aggregate(F.slice("kept", 1, most), start, fold))
    clipped = F.exists("f.out", lambda s: s["truncated"])
    return folded.select(
        "page_id", "query_id", F.col("f.out").alias("sections"), F.array_join(F.transform("f.out", lambda s: s["text"]), "\n\n").alias("text"),
        ((F.size("kept") > most) | F.col("f.stopped") | clipped).alias("truncated"), clipped.alias("section_truncated"), (F.size("kept") == 0).alias("none_relevant"),
    )


def overlap_at(a: DataFrame, b: DataFrame, k: int, item: str = "section_id") -> DataFrame:
    """The mean share of the first k that two rankings have in common."""
    top = lambda d, name: d.where(F.col("position") <= k).groupBy("query_id").agg(F.collect_set(item).alias(name))
    both = top(a, "x").join(top(b, "y"), "query_id", "full_outer")
    share = F.size(F.array_intersect(F.coalesce("x", F.array()), F.coalesce("y", F.array()))) / k
    return both.agg(F.round(F.avg(share), 6).alias("overlap"))
