"""SimHash near-duplicates: fingerprints, and a binary-trie self-join under a Hamming error budget.

The join sorts fingerprints, so that every trie node is a range of rows, and walks pairs of nodes level
by level: the bits in which the two nodes' prefixes differ are accumulated, and a pair is pruned as
soon as they exceed the budget. To spread this over executors a fingerprint of b bits is rotated
budget+1 times so that each of its budget+1 blocks leads once: two fingerprints within the budget
agree on at least one whole block, so their trie paths share that leading node in that rotation, and
(rotation, leading block) names an independent subtrie. A subtrie that holds too many fingerprints is
split: its rows go one more level band down, to every pair of child nodes within the budget.

Links are contracted to a star per component inside a task; all pairs of a group are never emitted.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other;
repeated rows are collapsed before the join and get the same answer; a row without doc_id links nothing, and its
component is that of an equal fingerprint, null where none has an id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batched, drop_written, numbers, values, whole_groups, written
from .graph import connected_components, local_forest
from .overlap import exact_links

#: Rows of a subtrie beyond which it is split over tasks.
SUBTRIE_ROWS = 50_000
#: Rows that share a window beyond which they meet through a pivot and in blocks.
WINDOW_ROWS = 2_048
#: Rows that a task takes up at once, at least.
AT_ONCE = 32_768
#: Bits a split descends at once.
BAND = 6
#: Node pairs that one task walks at once.
FRONTIER = 500_000
U = np.uint64


# --- fingerprints -------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, lower-cased in A-Z only."""
    return (text or "").encode().lower().split()


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, repeats included; fewer words are one run."""
    if not parts:
        return np.zeros(0, U)
    line, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(line, 42)], U)
    ends = list(accumulate([len(p) + 1 for p in parts]))
    starts = [0, *ends]
    return np.array([h(line[a: b - 1], 42) for a, b in zip(starts, ends[words - 1:], strict=False)], U)


def majorities(h: np.ndarray, lanes: int) -> np.ndarray:
    """Per lane the 64 bits set in over half of the hashes; lane 0 takes the hashes themselves, each other one a mix of them."""
    n, counts = len(h), np.zeros(64 * lanes, np.int64)
    steps = np.array([k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for k in range(lanes)], U)
    for i in range(0, n, 255):  # so many bits add up in one byte
        x = h[i: i + 255, None] + steps
        x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
        x ^= x >> U(31)
        x[:, 0] = h[i: i + 255]
        counts += np.add.reduce(np.unpackbits(x.byteswap().view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).view(">u8").astype(U) if n else np.zeros(lanes, U)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, k1, k2, fp array<long>): a 128-bit hash of the words, and one 64-bit SimHash per lane, as signed longs."""

    def made(batch: pa.RecordBatch) -> tuple[None, list]:
        k1, k2, out = [], [], []
        for text in values(batch, "text"):
            parts = words_of(text)
            digest = xxhash.xxh3_128_digest(b" ".join(parts))
            k1.append(int.from_bytes(digest[:8], "big", signed=True))
            k2.append(int.from_bytes(digest[8:], "big", signed=True))
            out.append(majorities(shingle_hashes(parts, words), lanes).view(np.int64))
        return None, [k1, k2, out]

    return batched(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], "k1 long, k2 long, fp array<long>", made)


# --- the trie join ------------------------------------------------------------------------------


def walk_pairs(values: np.ndarray, bits: int, roots: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) whose values differ in at most so many bits, for pairs of trie nodes.

    values: distinct and ascending within each root range; roots: rows (a_lo, a_hi, b_lo, b_hi, diff,
    level), a range of rows each, where level bits of the prefix are used up; a == b joins a node with itself.
    """
    ones = np.zeros((bits, len(values) + 1), np.int32)
    for level in range(bits):
        np.cumsum((values >> U(bits - 1 - level)) & U(1), out=ones[level, 1:])
    stack = [(int(level), roots[roots[:, 5] == level][:, :5]) for level in np.unique(roots[:, 5])]
    while stack:
        level, f = stack.pop()
        if len(f) > FRONTIER:
            stack += [(level, f[: len(f) // 2]), (level, f[len(f) // 2:])]
            continue
        if level == bits:
            same = (f[:, 0] == f[:, 2])
            f = f[~same]
            if len(f):
                yield f[:, 0], f[:, 2]
            continue
        # Where one leaf is left on both sides, the rest of the two paths is compared at once.
        single = (f[:, 1] - f[:, 0] == 1) & (f[:, 3] - f[:, 2] == 1)
        if single.any():
            g, f = f[single], f[~single]
            g = g[(g[:, 0] != g[:, 2]) & (np.bitwise_count((values[g[:, 0]] ^ values[g[:, 2]]) & U((1 << bits - level) - 1)) + g[:, 4] <= budget)]
            if len(g):
                yield g[:, 0], g[:, 2]
        if not len(f):
            continue
        a_lo, a_hi, b_lo, b_hi, diff = f.T
        c = ones[level]
        a_mid, b_mid = a_hi - (c[a_hi] - c[a_lo]), b_hi - (c[b_hi] - c[b_lo])
        itself = a_lo == b_lo
        kids = [
            np.stack([a_lo, a_mid, b_lo, b_mid, diff], 1), np.stack([a_mid, a_hi, b_mid, b_hi, diff], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi, diff + 1], 1), np.stack([a_mid, a_hi, b_lo, b_mid, diff + 1], 1)[~itself],
        ]
        k = np.concatenate(kids)
        alone = (k[:, 0] == k[:, 2]) & (k[:, 1] - k[:, 0] == 1)
        k = k[(k[:, 1] > k[:, 0]) & (k[:, 3] > k[:, 2]) & (k[:, 4] <= budget) & ~alone]
        if len(k):
            stack.append((level + 1, k))


def rotations(fps: DataFrame, bits: int, budget: int) -> DataFrame:
    """One row per (fingerprint, block that leads): node names the subtrie, v is the rotated value."""
    mask, edges = (1 << bits) - 1, [round(k * bits / (budget + 1)) for k in range(budget + 2)]
    rows = []
    v = F.col("v")
    for k in range(budget + 1):
        turn, lead = edges[k], edges[k + 1] - edges[k]
        signed = mask - (1 << 64) if bits == 64 else mask
        turned = v if not turn else (F.shiftleft(v, turn).bitwiseOR(F.shiftrightunsigned(v, bits - turn))).bitwiseAND(F.lit(signed))
        rows.append(F.struct(F.lit(k).alias("turn"), F.lit(lead).alias("level"), F.shiftrightunsigned(turned, bits - lead).alias("node_a"), turned.alias("v")))
    return (
        fps.withColumn("r", F.explode(F.array(*rows)))
        .select("rep", "r.turn", "r.level", "r.node_a", F.col("r.node_a").alias("node_b"), F.lit(0).alias("diff"), F.lit(0).alias("side"), "r.v")
    )


NODE = ["turn", "level", "node_a", "node_b", "diff"]


def split_nodes(rows: DataFrame, bits: int, budget: int, limit: int) -> DataFrame:
    """Descend in subtries of over so many rows until none is left; every pair of rows within the budget still meets in one node pair."""
    done = None
    while True:
        counts = rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
        # A pair of different nodes needs rows on both sides.
        counts = counts.where("n > 1 and (node_a = node_b or s0 <> s1)")
        if done is not None:  # children that no row can meet another in
            rows = written(rows.join(counts.select(*NODE), NODE, "left_semi").select(*rows.columns), "nodes")
        hot = written(counts.where((F.col("n") > limit) & (F.col("level") < bits)).select(*NODE), "hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rest = rows.join(hot, NODE, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        step = F.least(F.lit(BAND), F.lit(bits) - F.col("level"))
        big = rows.join(hot, NODE).withColumn("step", step)
        # A mask per child to visit: the set bits of x are the differences it spends.
        masks = F.expr(f"filter(sequence(0, int(power(2, step)) - 1), x -> bit_count(x) + diff <= {budget})")
        own = F.expr(f"shiftrightunsigned(v, {bits} - level - step)")  # the child this row lies in
        kids = big.withColumn("own", own).withColumn("x", F.explode(masks))
        same = F.col("node_a") == F.col("node_b")
        # The child of the other node, below that node's own prefix.
        kids = kids.withColumn("other", F.expr("shiftleft(if(side = 0, node_b, node_a), step) | ((own ^ x) & (shiftleft(1L, step) - 1))"))
        first = F.when(same, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
        kids = kids.select(
            *[c for c in rows.columns if c not in (*NODE, "side")], "turn", (F.col("level") + F.col("step")).alias("level"),
            first.alias("na"), F.when(same, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("nb"),
            (F.col("diff") + F.expr("bit_count(x)")).cast("int").alias("diff"),
            F.when(same & (F.col("x") != 0), (F.col("own") > F.col("other")).cast("int")).when(same, F.lit(0)).otherwise(F.col("side")).alias("side"),
        ).withColumnsRenamed({"na": "node_a", "nb": "node_b"}).select(*rows.columns)
        rows = written(kids, "nodes")


def trie_links(nodes: DataFrame, bits: int, budget: int, limit: int = SUBTRIE_ROWS) -> DataFrame:
    """Rows of trie nodes, v distinct by rep -> (a, b): stars over reps that share a node and whose v lie within the budget."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, NODE, AT_ONCE):
            key = np.stack([numbers(rows, c) for c in NODE], 1)
            side, v, rep = numbers(rows, "side"), numbers(rows, "v").view(U), numbers(rows, "rep")
            order = np.lexsort((v, side, *key.T[::-1]))
            key, side, v, rep = key[order], side[order], v[order], rep[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1) | (side[1:] != side[:-1])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(key))
            head, sides = key[start], side[start]
            alone = (sides == 0) & (head[:, 2] == head[:, 3]) & (stop - start > 1)
            pick = np.flatnonzero((sides[:-1] == 0) & (sides[1:] == 1) & (head[:-1] == head[1:]).all(axis=1))
            roots = np.concatenate([
                np.stack([start[alone], stop[alone], start[alone], stop[alone], head[alone, 4], head[alone, 1]], 1),
                np.stack([start[pick], stop[pick], start[pick + 1], stop[pick + 1], head[pick, 4], head[pick, 1]], 1),
            ])
            yield stars([np.stack([rep[i], rep[j]], 1) for i, j in walk_pairs(v, bits, roots, budget)])

    return split_nodes(nodes, bits, budget, limit).repartition(*NODE).sortWithinPartitions(*NODE).mapInArrow(links, "a long, b long")


def stars(pairs: list[np.ndarray]) -> pa.RecordBatch:
    a, b = local_forest(*np.concatenate([np.zeros((0, 2), np.int64), *pairs]).T)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# --- tries over windows of long fingerprints ----------------------------------------------------

#: What of a fingerprint travels with each window: v, the bits that the trie below a window reads, and three more lanes.
SKETCH = ["v", "s1", "s2", "s3"]
WINDOW = ["window", "block_a", "block_b"]


def apart(p: str, q: str) -> F.Column:
    """Differing bits of two sketches."""
    out = F.lit(0)
    for c in SKETCH:
        out = out + F.bit_count(F.col(f"{p}.{c}").bitwiseXOR(F.col(f"{q}.{c}")))
    return out


def window_blocks(rows: DataFrame, most: int, budget: int, limit: int) -> DataFrame:
    """(window, rep, sketch) with block_a, block_b and side: windows of over so many rows are cut into pairs of blocks.

    Rows whose sketch is near that of a window's first row, its pivot, are one candidate group by that; they meet the
    pivot and the rows that are not near it, but not each other. So a group of near copies costs one comparison a row.
    """
    hot = rows.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("rep", *SKETCH)).alias("pivot")).where(F.col("n") > limit)
    hot = written(hot.select("window", "pivot"), "hot")
    whole = lambda df: df.select("window", "rep", *SKETCH, F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), F.lit(0).alias("side"))
    if hot.isEmpty():
        return whole(rows)
    near = (F.bit_count(F.col("r.v").bitwiseXOR(F.col("pivot.v"))) <= budget) & (apart("r", "pivot") <= most)
    big = rows.alias("r").join(hot, "window").select("window", "r.rep", *[f"r.{c}" for c in SKETCH], near.alias("near"), (F.col("r.rep") == F.col("pivot.rep")).alias("first"))
    big = written(big, "hot-rows")
    blocks = lambda kind: F.ceil(F.count_if(kind) / limit).cast("int")
    sizes = written(big.groupBy("window").agg(blocks(F.col("near")).alias("c"), blocks(~F.col("near")).alias("r")), "sizes")
    # Block 0 is the pivot alone, 1 to r the rows that are not near it, the c after them those that are.
    dealt = F.when(F.col("near"), F.col("r") + 1 + F.pmod(F.xxhash64("rep"), "c")).otherwise(1 + F.pmod(F.xxhash64("rep"), "r")).cast("int")
    own = F.array(F.struct(dealt.alias("own"), F.when(F.col("near"), F.sequence(F.lit(0), "r")).otherwise(F.sequence(F.lit(1), F.col("r") + F.col("c"))).alias("others")))
    pivot = F.array(F.struct(F.lit(0).alias("own"), F.sequence(F.col("r") + 1, F.col("r") + F.col("c")).alias("others")))
    spread = big.join(sizes, "window").withColumn("s", F.explode(F.when(F.col("first"), F.concat(own, pivot)).otherwise(own))).withColumn("other", F.explode("s.others"))
    spread = spread.select("window", "rep", *SKETCH, F.least("s.own", "other").alias("block_a"), F.greatest("s.own", "other").alias("block_b"), (F.col("s.own") > F.col("other")).cast("int").alias("side"))
    return whole(rows.join(hot.select("window"), "window", "left_anti")).unionByName(spread)


def window_links(rows: DataFrame, budget: int, most: int) -> DataFrame:
    """(a, b): stars over reps that share a window and whose v differ in at most budget bits, their sketches in at most `most`."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, WINDOW, AT_ONCE):
            key = np.stack([numbers(table, c) for c in WINDOW], 1)
            side, rep = numbers(table, "side"), numbers(table, "rep")
            sketch = np.stack([numbers(table, c) for c in SKETCH], 1).view(U)
            order = np.lexsort((sketch[:, 0], side, *key.T[::-1]))
            yield stars(list(near_rows(key[order], side[order], rep[order], sketch[order], budget, most)))

    return rows.repartition(*WINDOW).sortWithinPartitions(*WINDOW).mapInArrow(links, "a long, b long")


def near_rows(key: np.ndarray, side: np.ndarray, rep: np.ndarray, sketch: np.ndarray, budget: int, most: int) -> Iterator[np.ndarray]:
    """Pairs of reps, contracted, of sorted rows: a trie over v per (window, block pair, side) is walked under the budget."""
    v = sketch[:, 0]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1) | (side[1:] != side[:-1])
    leaf = new.copy()
    leaf[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(leaf)  # the trie's leaves; rows of equal v lie behind one
    ends = np.append(at[1:], len(v))
    start = np.flatnonzero(new[at])
    stop = np.append(start[1:], len(at))
    head, sides = key[at[start]], side[at[start]]
    itself = (sides == 0) & (head[:, 1] == head[:, 2])
    pick = np.flatnonzero((sides[:-1] == 0) & (sides[1:] == 1) & (head[:-1] == head[1:]).all(axis=1))
    own = np.flatnonzero(itself & (stop - start > 1))
    level = np.zeros((len(own) + len(pick), 2), np.int64)
    roots = np.concatenate([np.stack([start[own], stop[own], start[own], stop[own]], 1), np.stack([start[pick], stop[pick], start[pick + 1], stop[pick + 1]], 1)])
    found = []
    # Rows of one leaf agree in all bits of v: a star each.
    rows_of = ends - at
    wide = np.flatnonzero((rows_of > 1) & np.repeat(itself, stop - start))
    for k in wide:
        found.append(np.stack([rep[at[k] + 1: ends[k]], np.full(rows_of[k] - 1, rep[at[k]])], 1))

    def settle(x: np.ndarray, y: np.ndarray) -> None:
        close = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= most
        if close.any():
            found.append(np.stack([rep[x[close]], rep[y[close]]], 1))
            if sum(map(len, found)) > 2 * FRONTIER:
                found[:] = [np.stack(local_forest(*np.concatenate(found).T), 1)]

    for i, j in walk_pairs(v[at], 64, np.hstack([roots, level]), budget):
        # Every row of one leaf with every row of the other, so many at a time.
        size = rows_of[i] * rows_of[j]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // FRONTIER)) + 1, [len(i)]])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            m, s, t = size[lo:hi], i[lo:hi], j[lo:hi]
            inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            width = np.repeat(rows_of[t], m)
            settle(np.repeat(at[s], m) + inside // width, np.repeat(at[t], m) + inside % width)
    yield from found


# --- operators ----------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 2, limit: int = SUBTRIE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at so many differing bits; the smallest doc_id reachable."""
    marked = written(fingerprints(docs, words).select("doc_id", F.col("fp")[0].alias("v")), "fingerprints")
    classes = written(marked.groupBy("v").agg(F.min("doc_id").alias("rep")), "classes")
    edges = trie_links(rotations(classes.where("rep is not null"), 64, budget), 64, budget, limit)
    comps = connected_components(edges)
    named = classes.join(comps, classes["rep"] == comps["id"], "left").select("v", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "v").select("doc_id", F.col("v").alias("fp"), "component_id")


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 12, window: int = 16, limit: int = WINDOW_ROWS, block: int = 512) -> DataFrame:
    """(doc_id, component_id): texts whose sets of so many words in a row have a Jaccard similarity of at least so much.

    Candidates come from SimHash, links from an exact comparison. The share of differing bits estimates the angle
    between two sets, and so their similarity. A trie per window of bits: its first levels allow no error and name the
    window; below, the bits of the first lane are walked under an error budget, and pairs left need 256 bits that are
    near enough; both limits lie three deviations beyond the mean at the similarity asked for. At 0.8 a pair meets in
    one of 48 windows of 16 bits with a chance of 0.97, at 0.85 of 0.997, if bits are independent. Candidates are
    contracted to groups, and within each group all pairs are compared exactly (overlap.exact_links).

    Texts with equal words are one class, compared once; classes that share a doc_id count as one. Rows without
    doc_id are left out. Beyond some tens of millions of documents take a wider window and more lanes.
    """
    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)  # share of bits that differ
    within = lambda n: int(n * angle + 3 * (n * angle * (1 - angle)) ** 0.5)
    known = docs.where("doc_id is not null")
    marked = written(fingerprints(known, words, lanes), "fingerprints")
    classes = written(marked.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.any_value("fp").alias("fp")), "classes")
    per_lane = 64 // window
    windows = F.array(*[
        F.shiftrightunsigned(F.col("fp")[k // per_lane], 64 - window * (k % per_lane + 1)).bitwiseAND(F.lit((1 << window) - 1)) + F.lit(k << window)
        for k in range(per_lane * lanes)
    ])
    rows = classes.select("rep", *[F.col("fp")[k].alias(c) for k, c in enumerate(SKETCH)], F.explode(windows).alias("window"))
    candidates = connected_components(window_links(window_blocks(rows, within(256), within(64), limit), within(64), within(256)))
    groups = written(candidates.select(F.col("id").alias("rep"), F.col("component").alias("family")), "groups")
    sets = written(shingle_sets(known, groups, words), "shingles")
    comps = written(connected_components(exact_links(sets, similarity, block)), "components")
    drop_written(sets, groups)
    named = classes.join(comps, classes["rep"] == comps["id"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, ["k1", "k2"]).select("doc_id", "component_id")


def shingle_sets(docs: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """(rep, family, h): the distinct shingle hashes, sorted, of each representative's text, as 64-bit little-endian bytes."""

    def made(batch: pa.RecordBatch) -> tuple[None, list]:
        return None, [[np.unique(shingle_hashes(words_of(t), words)).astype("<u8").tobytes() for t in values(batch, "text")]]

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(groups, "rep")
    return batched(texts, ["rep", "family"], "h binary", made)
