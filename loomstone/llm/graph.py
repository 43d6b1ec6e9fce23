"""Connected components over an edge table, without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_written, written


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contract the links one task has found to a star per component: (vertex, smallest vertex)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids[child], ids[label[child]]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (id, component): the smallest id each linked id reaches.

    Alternating large-star and small-star rounds; each round is two aggregations and two equi-joins
    and is written to the shared folder, so lost executors cost one round at most. Null ends and
    loops are ignored; ids without links are absent; an empty table gives an empty table. Hot
    vertices meet in partial aggregates first, and the joins may be split by adaptive execution.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    links = written(links, "links")
    before = None
    for _ in range(max_rounds):
        state = links.agg(
            F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("s"),
            F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
        ).first()
        state = (state["n"], state["s"], state["x"])
        if state == before or state[0] == 0:
            break
        before = state
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the joins below have exchanges of their own, which adaptive execution may split at a hot vertex.
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = written(
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct(), "large",
        )
        low2 = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        new = written(small, "links")
        for spent in (links, low, large, low2):
            drop_written(spent)
        links = new
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    parents = links.groupBy("a").agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    children = parents.select(F.col("a").alias("id"), "component")
    return children.union(roots.join(children.select("id"), "id", "left_anti"))
