"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by pseudo-random rotations, each three rounds of sign flips and a fast Hadamard
transform, and hashed to the nearest signed axis; some hashes together name a bucket of a table. Each
vector also probes the buckets of its runner-up axes. Pairs that share a bucket are verified by cosine
in double precision. Equal vectors are collapsed first and count by their number; a bucket of many
vectors is cut into blocks, each pair of blocks its own task, so none is dropped or capped. A pair is
counted only in the first bucket it shares.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite components links with
nothing; vectors of different lengths never link; equal rows link to each other; a row without vec_id
counts as a link of others, and has their component or none; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batched, numbers, values, whole_groups, written
from .graph import connected_components, local_forest

#: Vectors of a bucket that one block holds; rows that a task takes up, and pairs that it compares, at once.
BLOCK, AT_ONCE, PAIRS = 1024, 8192, 200_000
SEED = 20_240_601
#: Tables by the number of hashes that name a bucket.
TABLES = (8, 8, 16, 32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, h = *x.shape, 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def axes(x: np.ndarray, turn: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The best signed axes of each row after rotation number turn, best first, and their margins."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, turn, width])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
    probes = min(probes, width)
    top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    value = np.take_along_axis(y, top, 1)
    return (2 * top + (value < 0)).astype(np.int64), np.abs(value)


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Buckets of each row, tables * probes of them: a table's own one, then the likeliest runners-up."""
    out = np.zeros((len(x), tables, probes), np.int64)
    base = 2 << max(0, int(x.shape[1] - 1).bit_length())
    for t in range(tables):
        found = [axes(x, t * hashes + k, probes) for k in range(hashes)]
        width = min(f[0].shape[1] for f in found)
        own = np.zeros(len(x), np.int64)
        for code, _ in found:
            own = own * base + code[:, 0]
        # Probe p changes one hash to a runner-up; the smallest losses of margin come first.
        tries, losses = [own], [np.full(len(x), -1.0)]
        for k, (code, value) in enumerate(found):
            weight = base ** (hashes - 1 - k)
            for p in range(1, width):
                tries.append(own + (code[:, p] - code[:, 0]) * weight)
                losses.append(value[:, 0] - value[:, p])
        pick = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, :probes]
        got = np.take_along_axis(np.stack(tries, 1), pick, 1)
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1]:] = own[:, None]
    return out


def hashes_for(n: int, width: int) -> int:
    """Hashes that name a bucket, so that about eight unrelated vectors share one at any size."""
    return max(1, min(4, round(float(np.log(max(n, 2) / 8) / np.log(max(2 * width, 4))))))


def near_vectors(vectors: DataFrame, least: float = 0.95, tables: int | None = None, probes: int = 2, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding array<float>) -> vec_id, n_links, component_id, kept.

    tables: by default as many as find a pair at cosine 0.95 in 64 dimensions with a chance of 0.999 and more.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("e"))
    sound = (
        F.col("e").isNotNull() & (F.size("e") > 0)
        & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("e", lambda x: x != 0)
    )
    # Two hashes of different seeds. 0 + x: minus zero is zero.
    key = [F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2")]
    sound_rows = rows.where(sound).withColumn("e", F.transform("e", lambda x: x + F.lit(0).cast("float")))
    classes = sound_rows.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.select("e", "copies", *key, F.coalesce("rep", F.xxhash64("e")).alias("rep"), F.col("rep").isNull().alias("nameless")), "vectors")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("width")).first()
    hashes = hashes_for(shape["n"], shape["width"] or 1)
    tables = tables or TABLES[hashes - 1]

    def bucketed(batch: pa.RecordBatch) -> tuple[None, list]:
        rows = values(batch, "e")
        sizes = np.array([len(e) for e in rows])
        out, sent = [None] * len(rows), [None] * len(rows)
        for width in np.unique(sizes):
            at = np.flatnonzero(sizes == width)
            x = np.array([rows[k] for k in at], np.float32)
            y = x.astype(float)
            code = codes(y / np.linalg.norm(y, axis=1, keepdims=True), tables, hashes, probes).reshape(len(at), -1)
            for k, c, e in zip(at, code, x, strict=True):
                out[k], sent[k] = c, e.astype("<f4").tobytes()
        return None, [sizes.tolist(), out, sent]

    coded = written(batched(classes.select("rep", "copies", "e"), ["rep", "copies"], "width int, codes array<long>, x binary", bucketed), "codes")
    # Buckets are counted, and those of one vector dropped, before any vector moves.
    spots = coded.select("rep", "width", F.explode(F.array_distinct(F.transform("codes", lambda c, i: F.struct(F.floor(i / probes).cast("int").alias("t"), c.alias("code"))))).alias("s")).select("rep", "width", "s.t", "s.code")
    counts = spots.groupBy("width", "t", "code").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    shared = spots.join(counts, ["width", "t", "code"]).select("rep", "t", "code", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    shared = shared.join(coded, "rep").select("rep", "copies", "x", "codes", "width", "t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    group = ["width", "t", "code", "i", "j"]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group, AT_ONCE):
            key = np.stack([numbers(table, c) for c in group], 1)
            own, rep, n = numbers(table, "own"), numbers(table, "rep"), numbers(table, "copies")
            c = np.stack([np.asarray(v, np.int64) for v in table.column("codes").to_pylist()]).reshape(len(key), tables, probes)
            bounds = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            # Vectors of one width side by side; shorter ones are filled with zeros, which changes no product.
            data = [np.frombuffer(v, "<f4") for v in table.column("x").to_pylist()]
            x = np.zeros((len(key), max(map(len, data))))
            for k, v in enumerate(data):
                x[k, : len(v)] = v
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            weight, a_all, b_all = np.zeros(len(key), np.int64), [], []

            def settle(a: np.ndarray, b: np.ndarray) -> None:
                """Counts pairs of rows that are near, in the first bucket that both share."""
                first = np.ones(len(a), bool)
                for u in range(tables):
                    same = (c[a, u][:, :, None] == c[b, u][:, None, :]).any(axis=2)
                    earlier, here = u < key[a, 1], u == key[a, 1]
                    first &= ~(earlier & same.any(axis=1))
                    first &= ~(here & (same & (c[a, u] < key[a, 2][:, None])).any(axis=1))
                a, b = a[first], b[first]
                np.add.at(weight, a, n[b])
                np.add.at(weight, b, n[a])
                a_all.append(rep[a])
                b_all.append(rep[b])

            small = bounds[1:] - bounds[:-1] <= 32
            lo, size = bounds[:-1][small], (bounds[1:] - bounds[:-1])[small]
            for m in np.unique(size):
                u, v = np.triu_indices(m, 1)
                starts = lo[size == m]
                step = max(1, PAIRS // max(1, len(u)))
                for k in range(0, len(starts), step):
                    some = starts[k: k + step, None]
                    a, b = (some + u).ravel(), (some + v).ravel()
                    apart = (key[a, 3] != key[a, 4]) & (own[a] == own[b])
                    close = (np.einsum("ij,ij->i", x[a], x[b]) >= least) & ~apart
                    settle(a[close], b[close])
            for begin, end in zip(bounds[:-1][~small], bounds[1:][~small], strict=True):
                whole = np.arange(begin, end)
                i, j = key[begin, 3], key[begin, 4]
                left, right = (whole, whole) if i == j else (whole[own[begin:end] == i], whole[own[begin:end] == j])
                a, b = np.nonzero(x[left] @ x[right].T >= least)
                a, b = left[a], right[b]
                if i == j:
                    a, b = a[a < b], b[a < b]
                settle(a, b)
            hit = np.flatnonzero(weight)
            none = np.zeros(0, np.int64)
            p, q = local_forest(np.concatenate([none, *a_all]), np.concatenate([none, *b_all]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[hit], p])), pa.array(np.concatenate([np.full(len(hit), -1), q])), pa.array(np.concatenate([weight[hit], np.full(len(p), -1)]))], names=["a", "b", "n"]
            )

    found = written(shared.repartition(*group).sortWithinPartitions(*group).mapInArrow(verified, "a long, b long, n long"), "found")
    comps = connected_components(found.where("n < 0").select("a", "b"))
    links = found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    # Where a class without any vec_id holds a component's place, the smallest id of the others takes it.
    named = classes.select("rep", "nameless", "copies", "k1", "k2").join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), F.when(~F.col("nameless"), F.col("rep")).alias("named"),
    )
    names = named.groupBy("component").agg(F.min("named").alias("component_id"))
    named = named.join(names, "component")
    keyed = sound_rows.select("vec_id", *key).unionByName(rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2")))
    return keyed.join(named, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
