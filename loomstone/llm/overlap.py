"""Exact set similarity within families of candidates, in blocks of bounded size.

A family's sets are dealt to blocks by hash; inside a block all pairs are compared. A family of several blocks
then meets its hubs, the sets with most links in their blocks, and what the hubs join is one component. Only
sets outside a family's largest component go on to meet all of its blocks, a task per pair of blocks. So a
family whose members are near one hub costs a few comparisons a member, and no family is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import numbers, values, whole_groups, written
from .graph import connected_components, local_forest

#: Hashes that a block's sets hold together, about; hubs of a family; columns of a dense part; rows that a task takes up at once.
BLOCK_HASHES, HUBS, DENSE, AT_ONCE = 1_000_000, 16, 4096, 2048
KEYS = ["family", "block_a", "block_b"]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets have in common, as a square matrix."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros(n * n)
    order = np.argsort(token, kind="stable")
    row = row[order]
    begin = np.cumsum(times) - times
    # Rare hashes add to each pair of rows that they name; frequent ones are multiplied as dense columns.
    for t in range(2, min(9, n + 1)):
        here = begin[times == t]
        if len(here):
            rows = row[here[:, None] + np.arange(t)]
            for a in range(t):
                for b in range(a):
                    out += np.bincount(rows[:, a] * n + rows[:, b], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    many = np.flatnonzero(times >= 9)
    for k in range(0, len(many), DENSE):
        part = many[k: k + DENSE]
        x = np.zeros((n, len(part)), np.float32)
        for c, p in enumerate(part):
            x[row[begin[p]: begin[p] + times[p]], c] = 1
        out += x @ x.T
    return out


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of at least that Jaccard similarity; where both sides occur, pairs across them."""
    size = np.array([len(s) for s in sets])
    both = side.any() and not side.all()
    if len(sets) <= 6:
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if not both or side[i] != side[j]]
        pairs = [(i, j) for i, j in pairs if min(size[i], size[j]) >= similarity * max(size[i], size[j]) - 1e-9]
        got = [p for p in pairs if _similar(len(np.intersect1d(sets[p[0]], sets[p[1]], assume_unique=True)), size[p[0]], size[p[1]], similarity)]
        i, j = np.array(got, np.int64).reshape(-1, 2).T
        return i, j
    i, j = np.nonzero(np.triu(_similar(shared_counts(sets), size[:, None], size[None, :], similarity), 1))
    ok = side[i] != side[j] if both else np.ones(len(i), bool)
    return i[ok], j[ok]


def _similar(common, a, b, similarity: float):
    return common >= similarity * (a + b - common) - 1e-9


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """(family, block_a, block_b, side, rep, h) -> (a, b): stars over similar sets of each block pair; (hub, null): its set with most links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEYS, AT_ONCE):
            key = np.stack([numbers(table, c) for c in KEYS], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            rep, side, bounds = numbers(table, "rep"), numbers(table, "side"), [0, *cut, len(key)]
            a, b, hubs = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(h, "<u8") for h in table.column("h")[lo:hi].to_pylist()]
                i, j = alike(sets, side[lo:hi], similarity)
                if len(i):
                    ids = rep[lo:hi]
                    x, y = local_forest(ids[i], ids[j])
                    a.append(x)
                    b.append(y)
                    hubs.append(ids[np.bincount(np.concatenate([i, j]), minlength=hi - lo).argmax()])
            none = np.zeros(0, np.int64)
            x, y = np.concatenate([none, *a]), np.concatenate([none, *b])
            yield pa.RecordBatch.from_arrays([pa.array([*x, *hubs], pa.int64()), pa.array([*y, *[None] * len(hubs)], pa.int64())], names=["a", "b"])

    return rows.select(*KEYS, "side", "rep", "h").repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(links, "a long, b long")


def exact_links(sets: DataFrame, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """(rep, family, h: sorted distinct 64-bit hashes) -> (a, b): links within families that reach the similarity, contracted to stars.

    A set without hashes is similar to none. A family of one set, and a null family, link nothing.
    """
    sets = sets.where("family is not null and length(h) > 0")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.length("h")) / (8 * BLOCK_HASHES))).cast("int")
    sizes = written(sets.groupBy("family").agg(F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1"), "families")
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    dealt = sets.join(sizes, "family").select("rep", "family", "h", "blocks", own.alias("own"))
    found = written(compared(dealt.select("rep", "family", "h", F.col("own").alias("block_a"), F.col("own").alias("block_b"), F.lit(0).alias("side")), similarity), "links")
    wide = sizes.where("blocks > 1")
    if wide.isEmpty():
        return found.where("b is not null")
    wide = written(dealt.where("blocks > 1"), "wide")
    # The hubs of a family, one a block at most, meet all of its blocks.
    hubs = found.where("b is null").select(F.col("a").alias("rep")).distinct()
    few = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("rep"), "rep"))
    hubs = written(wide.join(hubs, "rep", "left_semi").withColumn("k", few).where(F.col("k") <= HUBS).drop("k", "own"), "hubs")
    beside = hubs.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = lambda df, side: df.select("rep", "family", "h", F.col("own").cast("int").alias("block_a"), F.lit(-1).alias("block_b"), F.lit(side).alias("side"))
    met = written(compared(at(wide, 0).unionByName(at(beside, 1)), similarity), "links")
    so_far = found.unionByName(met).where("b is not null")
    comps = written(connected_components(so_far), "components")
    named = wide.join(comps, F.col("rep") == F.col("id"), "left").select("rep", "family", "h", "blocks", F.coalesce("component", "rep").alias("component"))
    # The rest of a family: what is not in its largest component. It meets itself and that component, block by block.
    most = named.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    marked = written(named.join(most, "family").withColumn("rest", F.col("component") != F.col("main")), "rest")
    count = lambda kind: F.greatest(F.ceil(F.count_if(kind) / F.ceil(F.count("*") / F.max("blocks"))), F.lit(1)).cast("int")
    shape = written(marked.groupBy("family").agg(count(F.col("rest")).alias("r"), count(~F.col("rest")).alias("c"), F.bool_or("rest").alias("any")).where("any").drop("any"), "shape")
    spot = F.when(F.col("rest"), F.pmod(F.xxhash64("rep"), "r")).otherwise(F.col("r") + F.pmod(F.xxhash64("rep"), "c")).cast("int")
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("r") + F.col("c") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))
    spread = marked.join(shape, "family").withColumn("spot", spot).withColumn("other", F.explode(others)).select(
        "rep", "family", "h", F.least("spot", "other").alias("block_a"), F.greatest("spot", "other").alias("block_b"), (F.col("spot") > F.col("other")).cast("int").alias("side")
    )
    last = written(compared(spread, similarity), "links")
    # What is joined already goes on as stars, which settle in few rounds.
    return comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(last.where("b is not null"))
