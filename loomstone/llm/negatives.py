"""Hard negatives by Fagin's threshold algorithm.

Vectors become whole numbers (floor(256 * entry)), so scores are exact. Anchors meet all candidates in blocks: a
task holds a block of anchors and a block of candidates, both of bounded size, with a list of the candidates per
dimension, sorted by that entry. An anchor reads each list from the end that its own entry's sign asks for, scores
every candidate that it meets for the first time, and keeps the best of each of its windows. The threshold, the score
of a vector made of the last entries read, bounds all candidates not met yet; an anchor stops once it is strictly below
the worst kept score of each window that is full, and below the window's lower end for others (equal scores go by
smaller id, so a tie may not be left unread). What blocks keep is ranked per window over all blocks.

Edge cases: a row without vec_id or label, or whose vector is null, empty, or holds null or non-finite entries takes no
part; of rows that share a vec_id the one of the smallest label, then smallest vector counts; vectors of different
lengths never meet; entries are held to a bound by width at which every score fits a long (above 100,000 for 64
dimensions); an anchor without other rows of its label, or with windows that are empty, has no rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import numbers, written
from .whitening import matrix_of, scaled, sound

POSITIVES, NEGATIVES = 5, 5
#: Anchors and candidates of a block; places that an anchor reads of each list before it first looks at the threshold.
ANCHORS, CANDIDATES, FIRST = 2048, 8192, 16


@dataclass
class Lists:
    """Candidates of one block and, per dimension, their order by that entry."""

    ids: np.ndarray
    x: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.x, axis=0, kind="stable").T
        self.ordered = np.take_along_axis(self.x.T, self.order, 1)

    def best(self, anchor: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best (ids, scores) of each window low <= score <= high, the anchor itself left out."""
        n, kept = len(self.ids), [(np.zeros(0, np.int64), np.zeros(0, self.x.dtype)) for _ in low]
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, read, depth = np.zeros(n, bool), 0, min(FIRST, n)
        done = np.zeros(len(low), bool)
        while read < n:
            if len(up) + len(down):
                met_now = np.zeros(n, bool)
                met_now[self.order[up, n - depth: n - read].ravel()] = True
                met_now[self.order[down, read: depth].ravel()] = True
                met_now &= ~met
            else:  # a zero vector scores zero with all
                met_now, depth = ~met, n
            new = np.flatnonzero(met_now)
            met |= met_now
            score = self.x[new] @ anchor
            other = self.ids[new] != own
            new, score = new[other], score[other]
            threshold = anchor[up] @ self.ordered[up, n - depth] + anchor[down] @ self.ordered[down, depth - 1]
            for w in range(len(low)):
                if done[w]:
                    continue
                inside = np.flatnonzero((score >= low[w]) & (score <= high[w]))
                if len(inside):
                    ids, scores = np.concatenate([kept[w][0], self.ids[new[inside]]]), np.concatenate([kept[w][1], score[inside]])
                    top = np.lexsort((ids, -scores))[:k]
                    kept[w] = ids[top], scores[top]
                # No unread candidate reaches a full window's last place, or a window at all.
                done[w] = threshold < (max(kept[w][1][-1], low[w]) if len(kept[w][0]) == k else low[w])
            if done.all():
                break
            read, depth = depth, min(n, 2 * depth)
        return kept


def prepared(vectors: DataFrame) -> DataFrame:
    """(id, label, x, width): one row an id, of those that take part."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.when(sound(e), scaled(e)).alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null").withColumn("width", F.size("x"))
    # The square of the bound times the width is at most 2^56, and a hundred times that fits a long.
    bound = F.floor(F.sqrt(F.lit(float(1 << 56)) / F.col("width"))).cast("long")
    held = rows.groupBy("id").agg(F.min(F.struct("label", F.transform("x", lambda v: F.greatest(-bound, F.least(bound, v))).alias("x"), "width")).alias("r"))
    return held.select("id", "r.label", "r.x", "r.width")


def met_in_blocks(anchors: DataFrame, candidates: DataFrame, k: int, windows: bool, block: int, anchor_block: int) -> DataFrame:
    """The k best candidates of each window of each anchor and block: anchor_id, positive_id, positive_score, id, score.

    windows false: the best of the anchor's own label, without bounds. Else anchors have the arrays positives and
    scores, a window for each positive: other labels, 80 % to 100 % of its score.
    """
    n, m = candidates.count(), anchors.count()
    lanes, groups = max(1, -(-n // block)), max(1, -(-m // anchor_block))
    deal = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = anchors.withColumn("g", deal(1, groups)).withColumn("l", every(lanes))
    # Own names for one side: both may come from one table, whose columns a cogroup does not tell apart.
    right = candidates.withColumn("l", deal(2, lanes)).withColumn("g", every(groups)).select(*[F.col(c).alias(f"c_{c}") for c in ("g", "l", "width", "id", "label", "x")])
    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]

    def met(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and c.num_rows:
            x, y = matrix_of(a), matrix_of(c, "c_x")
            # Products below 2^53 are exact as doubles, which numpy multiplies much faster.
            most = int(max(np.abs(x).max(), np.abs(y).max()))
            if most * most * x.shape[1] < 1 << 53:
                x, y = x.astype(float), y.astype(float)
            ids, label = numbers(c, "c_id"), numbers(c, "c_label")
            own, own_label = numbers(a, "id"), numbers(a, "label")
            positives, scores = (a.column(name).to_pylist() for name in ("positives", "scores")) if windows else (None, None)
            lists = {}
            for value in np.unique(own_label):
                some = label != value if windows else label == value
                if some.any():
                    lists[value] = Lists(ids[some], y[some])
                for row in np.flatnonzero(own_label == value) if value in lists else ():
                    p = np.array(scores[row], np.int64) if windows else None
                    # 80 p <= 100 s: s at least 4 p / 5, rounded up.
                    low, high = (-(-4 * p // 5), p) if windows else (np.array([-np.inf]), np.array([np.inf]))
                    for w, (found, score) in enumerate(lists[value].best(x[row], int(own[row]), low, high, k)):
                        if len(found):
                            positive = (positives[row][w], int(p[w])) if windows else (0, 0)
                            out.append((np.full(len(found), own[row]), np.full(len(found), positive[0]), np.full(len(found), positive[1]), found, score.astype(np.int64)))
                if windows:
                    lists.pop(value, None)
        columns = [np.concatenate(col) for col in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(col, pa.int64()) for col in columns], names=names)

    return left.groupBy("g", "l", "width").cogroup(right.groupBy("c_g", "c_l", "c_width")).applyInArrow(met, ", ".join(f"{c} long" for c in names))


def first_k(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = CANDIDATES, anchor_block: int = ANCHORS) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on the column id. A positive is one of the anchor's best rows of the same label; its
    negatives are the best rows of other labels that score 80 % to 100 % of what it scores.
    """
    rows = written(prepared(vectors), "integers")
    anchors = rows.where(is_anchor)
    near = first_k(met_in_blocks(anchors, rows, positives, False, block, anchor_block), ["anchor_id"], positives)
    pairs = near.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most `positives` each
    asked = written(anchors.join(pairs, "id").select("id", "label", "x", "width", F.col("p.id").alias("positives"), F.col("p.score").alias("scores")), "anchors")
    found = first_k(met_in_blocks(asked, rows, negatives, True, block, anchor_block), ["anchor_id", "positive_id"], negatives)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").alias("negative_score"),
    )
