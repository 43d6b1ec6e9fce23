"""Packing documents into fixed-length training sequences by cutting-stock column generation.

Each document becomes ids, then the end id. A document longer than the sequence length is cut at
multiples of that length; those full pieces fill a sequence each. What remains is cut once more, after
the last multiple of a quarter of the length, so that no piece of an odd size is larger than that. The
pieces are the orders of a cutting-stock problem: a linear program over patterns of length classes,
columns priced by a knapsack dynamic program, solutions rounded, and ranked pieces dealt to the slots
of the rounded patterns.

Only the histogram of length classes (at most length/grain rows, whatever the input) reaches the
driver. Pieces are ranked within (class, bucket); a class has as many buckets as its number of pieces
asks for, so a length that a third of all documents share is spread over many tasks at any size.

Edge cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur,
each keeping its own row key; a null doc_id stays null, and no id passes through Python; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import batched, values, written

#: The share by which a relaxed solution may exceed its bound.
GAP = 1e-4
#: Chunks whose ids a worker keeps, at most; pieces of a class that one bucket holds, about; buckets of a class, at least.
CACHE, BUCKET_ROWS, BUCKETS = 100_000, 250_000, 64
#: Where cutting a text before single spaces could change its ids: runs of three blanks, or two at the end.
LONG_BLANKS = re.compile(r"\s\s\s|\s\s\Z")
SPECIAL = "<|endoftext|>"
_workers: dict[str, Ids] = {}


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, each distinct chunk encoded once.

    Byte-level pre-tokens never reach from a word into the space after it, so a text may be cut before
    each single space; ids of the chunks, joined, are the ids of the text.
    """

    def __init__(self, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        encode, pack = self.encoding.encode_ordinary, np.array

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                out = pack(encode(chunk), "<u4").tobytes()
                if len(self) >= CACHE:
                    self.clear()
                if len(chunk) < 64:
                    self[chunk] = out
                return out

        self.chunks = Chunks()

    def of(self, text: str) -> bytes:
        if SPECIAL in text or LONG_BLANKS.search(text):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        first, *rest = text.split(" ")
        get = self.chunks.__getitem__
        return get(first) + b"".join([get(" " + x) for x in rest]) if rest else get(first)


def encoder(ranks_path: str) -> Ids:
    if ranks_path not in _workers:
        _workers[ranks_path] = Ids(ranks_path)
    return _workers[ranks_path]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, whole quarters, the rest."""
    full = n // length * length
    quarters = (n - full) // (length // 4) * (length // 4)
    rest = n - full - quarters
    return [(at, length) for at in range(0, full, length)] + [(full, quarters)] * (quarters > 0) + [(full + quarters, rest)] * (rest > 0)


def cut_pieces(docs: DataFrame, ranks_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: where it starts in its document, its length and the CRC-32 of its ids."""

    def pieces(batch: pa.RecordBatch) -> tuple[list[int], list]:
        ids, tail, at, rows = encoder(ranks_path), np.array([end_id], "<u4").tobytes(), [], []
        for k, text in enumerate(values(batch, "text")):
            data = memoryview(ids.of(text or "") + tail)
            n = len(data) // 4
            made = [(start, size, zlib.crc32(data[4 * start: 4 * (start + size)]), n) for start, size in cuts(n, length)]
            rows += made
            at += [k] * len(made)
        return at, list(zip(*rows, strict=True)) or [[]] * 4

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long"), "text")
    return batched(rows, ["row_key", "doc_id"], "start long, length long, ids_crc32 long, doc_tokens long", pieces)


# --- the linear program -------------------------------------------------------------------------


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest dual value: an unbounded knapsack by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    items = np.flatnonzero(duals > 1e-12)
    if not len(items):
        return 0.0, np.zeros(len(sizes), int)
    w, v = sizes[items], duals[items]
    for c in range(1, room + 1):
        fits = w <= c
        if fits.any():
            value = best[c - w[fits]] + v[fits]
            k = int(value.argmax())
            if value[k] > best[c - 1] + 1e-15:
                best[c], took[c] = value[k], items[fits][k]
                continue
        best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), int), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with pivoting: no threaded library call on the driver."""
    n = len(a)
    m = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        factors = m[:, k].copy()
        factors[k] = 0
        m -= factors[:, None] * m[k]
    return m[:, n:]


def solve(sizes: np.ndarray, counts: np.ndarray, room: int, steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (one per row) and how often the relaxed optimum uses each.

    Revised simplex over one row per class; the basis starts with one single-class pattern per class.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))  # a column per pattern
    inverse = np.diag(1 / np.diag(basis))
    x = counts / np.diag(basis)
    least = float(sizes @ counts) / room
    for step in range(steps):
        if x.sum() <= least * (1 + 1e-5):
            break  # no packing takes less
        duals = inverse.sum(axis=0)
        value, pattern = price(duals, sizes, room)
        if value <= 1 + GAP:
            break  # the duals, divided by that value, bound every packing from below
        column = inverse @ pattern
        able = column > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = x[able] / column[able]
        out = int(ratio.argmin())
        t = ratio[out]
        x = np.maximum(x - t * column, 0)
        x[out] = t
        basis[:, out] = pattern
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        if step % 200 == 199:
            inverse = inverted(basis)
            x = np.maximum(inverse @ counts, 0)
    return basis.T.round().astype(int), x


def plan(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns with whole counts that hold exactly counts pieces of every class.

    The relaxed solution is rounded down; what is left is packed best-fit decreasing, class by class.
    """
    if not len(sizes):
        return []
    patterns, x = solve(sizes, counts, room)
    left, out = counts.copy(), []
    for p, n in sorted(zip(patterns, x, strict=True), key=lambda z: -z[1]):
        n = int(n + 1e-9)
        used = np.flatnonzero(p)
        n = min([n, *(left[used] // p[used])]) if len(used) else 0
        if n > 0:
            out.append((p, int(n)))
            left = left - n * p
    order = np.argsort(-sizes)
    while left.any():
        p, c = np.zeros(len(sizes), int), room
        for k in order:
            take = min(left[k], c // sizes[k])
            p[k] += take
            c -= take * sizes[k]
        used = np.flatnonzero(p)
        n = int((left[used] // p[used]).min())
        out.append((p, n))
        left = left - n * p
    return out


def pack(docs: DataFrame, ranks_path: str, length: int = 2048, end_id: int = 1, grain: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces with their place: sequence_id and offset, gapless from 0 within a sequence.

    grain: lengths are planned in units of so many ids (rounded up), so a sequence of the plan holds
    at most length/grain units; the padding it costs is under grain ids a piece.
    """
    spark = docs.sparkSession
    units, room = F.ceil(F.col("length") / grain).cast("int"), length // grain
    cut = written(cut_pieces(docs, ranks_path, length, end_id).withColumn("class", units), "pieces")
    # A row per class: as many buckets as its pieces fill.
    classes = written(cut.groupBy("class").agg(F.greatest(F.lit(BUCKETS), F.ceil(F.count("*") / bucket_rows)).cast("int").alias("buckets")), "classes")
    keyed = cut.join(F.broadcast(classes), "class").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "row_key"), "buckets").cast("int"))
    parts = keyed.groupBy("class", "bucket").agg(F.count("*").alias("n")).collect()  # at most room * BUCKETS rows, and one per bucket_rows pieces
    counts: dict[int, int] = {}
    begins = []
    for r in sorted(parts, key=lambda r: (r["class"], r["bucket"])):
        begins.append((r["class"], r["bucket"], counts.get(r["class"], 0)))
        counts[r["class"]] = counts.get(r["class"], 0) + r["n"]
    sizes = np.array(sorted(counts), int)
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan(sizes, np.array([counts[s] for s in sizes], int), room):
        place = 0
        for k in np.flatnonzero(pattern)[::-1]:
            size, each = int(sizes[k]), int(pattern[k])
            slots.append((size, used[size], used[size] + each * times, each, sequence, place))
            used[size] += each * times
            place += each
        sequence += times
    begin = spark.createDataFrame(begins, "class int, bucket int, begin long")
    slot = spark.createDataFrame(slots, "class int, low long, high long, each int, first_sequence long, place int")
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "row_key")) - 1
    ranked = keyed.withColumn("rank", rank).join(F.broadcast(begin), ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("begin"))
    # Slots of a class are consecutive ranges of ranks: an array per class, so that this stays a plain equi-join.
    ranges = slot.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "first_sequence", "place"))).alias("slots"))
    dealt = (
        ranked.join(F.broadcast(ranges), "class")
        .withColumn("slot", F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0])
        .withColumn("i", F.col("rank") - F.col("slot.low"))
        .withColumn("sequence_id", F.col("slot.first_sequence") + F.floor(F.col("i") / F.col("slot.each")))
        .withColumn("place", F.col("slot.place") + F.pmod(F.col("i"), F.col("slot.each")))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"),
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"), "row_key",
    )
