"""Retrieval quality: per-query measures, summaries, nearest-rank percentiles, gates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialized, removed

#: Thresholds of the gates.
RECALL, MRR, NDCG, P95_MS, GAIN, LATENCY_RATIO, SLICE_GAIN = 0.85, 0.70, 0.75, 150.0, 0.02, 2.5, 0.10
#: Bins that a selection counts at once, and rows that it ranks in one place.
BINS, SMALL = 1024, 10_000


def query_quality(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id), (query_id, item, position), (query_id, item, grade) -> a row of measures per query.

    An item counts at its first position. A query without relevant items has recall and nDCG one.
    """
    relevant = qrels.where("grade > 0").groupBy("query_id", item).agg(F.max("grade").alias("grade"))
    graded = first_ten(ranking, item).join(relevant, ["query_id", item], "left")
    return graded_quality(queries, graded, relevant.groupBy("query_id", "grade").agg(F.count("*").alias("n")))


def first_ten(ranking: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id, item, rank): the ten first items of each ranking, each at its first position."""
    first = ranking.groupBy("query_id", item).agg(F.min("position").alias("position"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position", item))).where("rank <= 10").drop("position")


def graded_quality(queries: DataFrame, top: DataFrame, totals: DataFrame) -> DataFrame:
    """The measures from the ten first items (query_id, rank, grade: null where not relevant) and how many items of each grade a query has (query_id, grade, n).

    The relevant items themselves are not needed, so a query may have any number of them.
    """
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = top.groupBy("query_id").agg(
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_rank"), F.sum(F.when(F.col("grade") > 0, gain)).alias("dcg"), F.count_if(F.col("grade") > 0).alias("hits10"),
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= 5)).alias("hits5"), F.lit(True).alias("any"),
    )
    # The ideal ranking has the highest grades first: of each grade the ranks from the count of higher ones on, at most ten.
    higher = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc())) - F.col("n")
    ideal = totals.where("grade > 0").withColumn("ahead", higher).withColumn("ranks", F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")))
    gains = F.aggregate(F.filter(F.transform("ranks", lambda r: r + F.col("ahead")), lambda r: r <= 10), F.lit(0.0), lambda a, r: a + (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(r + 1))
    best = ideal.groupBy("query_id").agg(F.sum("n").alias("n_relevant"), F.sum(gains).alias("ideal"))
    out = queries.join(best, "query_id", "left").join(got, "query_id", "left")
    return out.select(
        *queries.columns, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), F.when(F.col("n_relevant").isNull(), 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
        F.when(F.col("n_relevant").isNull(), 1.0).otherwise(F.coalesce("hits10", F.lit(0)) / F.col("n_relevant")).alias("recall"), (F.coalesce("hits5", F.lit(0)) / 5).alias("precision"), F.col("any").isNull().alias("zero_result"),
    )


def summary(measures: DataFrame, *by: str) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return measures.groupBy(*by).agg(
        F.count("*").alias("queries"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"), mean("recall").alias("recall"), mean("precision").alias("precision"),
        mean(F.col("zero_result").cast("double")).alias("zero_result_rate"),
    )


def nearest_ranks(rows: DataFrame, x: str, fractions: dict[str, float], *by: str, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """by, and for each name the value of nearest rank: the smallest one that so large a fraction of the group's values does not exceed.

    A distributed selection, exact at any size: each group's span of values is cut into bins by value, the bins are
    counted with partial sums, and the one that holds a wanted rank is cut again, until it holds few rows; only those are ranked. So
    no task holds a group, and what is shuffled are counts. Nulls and NaN are left out; a group of them has null.
    """
    values = rows.select(*by, F.when(~F.isnan(F.col(x).cast("double")), F.col(x)).alias("_x"))
    keys = [*by, "_f"]
    same = lambda a, b: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by), F.lit(True))
    held = values.where("_x is not null").withColumn("_d", F.col("_x").cast("double"))
    stats = held.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    wanted = F.explode(F.create_map(*[F.lit(v) for pair in fractions.items() for v in pair])).alias("_f", "_q")
    # A row per group and fraction: the rank wanted among the rows between lo and hi, and how many those are.
    open_ = stats.select(*by, wanted, "_n", "_lo", "_hi").withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_q") * F.col("_n"))).cast("long"))
    open_ = materialized(open_.select(*keys, "_rank", "_n", "_lo", "_hi"), "ranks")
    for _ in range(64):
        wide = open_.where((F.col("_n") > small) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_d") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)).cast("int")
        met = held.alias("a").join(wide.alias("b"), same("a", "b") & F.col("_d").between(F.col("_lo"), F.col("_hi"))).select(*[f"b.{k}" for k in keys], "_d", bin_.alias("_b"))
        counts = met.groupBy(*keys, "_b").agg(F.count("*").alias("_k"), F.min("_d").alias("_l"), F.max("_d").alias("_h"))
        ahead = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_k")  # at most `bins` rows each
        cut = counts.withColumn("_ahead", ahead).alias("c").join(wide.alias("w"), reduce(and_, (F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys)))
        cut = cut.where((F.col("_ahead") < F.col("_rank")) & (F.col("_rank") <= F.col("_ahead") + F.col("_k")))
        cut = cut.select(*[f"w.{k}" for k in keys], (F.col("_rank") - F.col("_ahead")).alias("_rank"), F.col("_k").alias("_n"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi"))
        done = open_.where(~((F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))))
        spent, open_ = open_, materialized(done.unionByName(cut), "ranks")
        removed(spent)
    # What is left of a group lies between two values: few rows, or equal ones, which one row stands for.
    left = held.alias("a").join(open_.alias("b"), same("a", "b") & F.col("_d").between(F.col("_lo"), F.col("_hi")))
    distinct = left.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], "_rank", "_x").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_x"))
    found = distinct.withColumn("_upto", upto).where("_upto >= _rank").groupBy(*keys).agg(F.min("_x").alias("_v"))
    wide_row = found.groupBy(*by).agg(*[F.max(F.when(F.col("_f") == name, F.col("_v"))).alias(name) for name in fractions])
    groups = values.groupBy(*by).agg(F.max("_x").alias("max"))
    joined = groups.alias("a").join(wide_row.alias("b"), same("a", "b"), "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in by], *[F.col(f"b.{n}").alias(n) for n in fractions], F.col("a.max").alias("max"))


def latency_summary(rows: DataFrame, x: str, *by: str) -> DataFrame:
    """by, p50, p95, p99 and max: exact nearest ranks."""
    return nearest_ranks(rows, x, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *by)


def strategy(row: DataFrame) -> DataFrame:
    """(recall, mrr, ndcg, p95, gain, latency_ratio) -> recommendation."""
    good = (F.col("recall") >= RECALL) & (F.col("mrr") >= MRR) & (F.col("ndcg") >= NDCG) & (F.col("p95") <= P95_MS)
    return row.withColumn("recommendation", F.when((F.col("gain") >= GAIN) & (F.col("latency_ratio") <= LATENCY_RATIO) & (F.col("p95") <= P95_MS), "adopt_rerank").when(good, "keep_lexical").otherwise("evaluate_embeddings"))


def fusion_gate(row: DataFrame) -> DataFrame:
    """(gain, paraphrase_gain, multi_gain, p95) -> adopt or not."""
    slices = (F.col("paraphrase_gain") >= SLICE_GAIN) | (F.col("multi_gain") >= SLICE_GAIN)
    return row.withColumn("adopt", (F.col("gain") >= GAIN) & slices & (F.col("p95") <= P95_MS))


def failures(measures: DataFrame) -> DataFrame:
    """Queries that some method does not recall wholly."""
    return measures.groupBy("query_id").agg(F.min("recall").alias("worst_recall")).where("worst_recall < 1")


def size_reduction(bounded: DataFrame, whole: DataFrame, x: str) -> DataFrame:
    a, b = bounded.agg(F.sum(x).alias("bounded")), whole.agg(F.sum(x).alias("whole"))
    return a.join(F.broadcast(b)).withColumn("reduction_percent", F.round(100 * (1 - F.col("bounded") / F.col("whole")), 2))
