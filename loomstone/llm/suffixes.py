"""Removal of repeated substrings by a hash-compared suffix sort.

Every byte that lies in a string of `least` bytes which also starts earlier (in a document of smaller id, or earlier
in the same one) goes. Strings of all documents cannot be sorted in one place, so equal ones are brought together
first: the smallest hashed gram of a window of `least` bytes stands at the same place in equal windows, so windows
are dealt by it. Neighbouring windows of one gram form a context. Contexts with equal hashes (two of 64 bits) hold the
same windows, and all but the first are repeats. Where a gram has several contexts, the suffixes that start their
windows are sorted: two suffixes are compared by prefix polynomial hashes, with a binary search for their common
extension, in a mergesort over all buckets at once; the order is then verified by the bytes themselves, and sorted by
them where a hash collided. Grams of more contexts than `bucket` are dealt anew by the hashes of their whole
windows, so no task holds a group that grows with the corpus.

Edge cases: a null text is empty; texts are compared as UTF-8 bytes and never across documents; rows that agree in
doc_id and text are one document, whose result all of them get; rows that share a doc_id otherwise follow each other
in the order of their texts' hashes; rows without doc_id come last; texts shorter than `least` keep all; an empty
table gives an empty result; other columns stay, but for those that the operator makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import batched, drop_written, numbers, whole_groups, written

LEAST, GRAM, BUCKET = 100, 40, 2048
#: Starts that one piece of a long document has, bytes hashed at once, and contexts sorted at once.
PIECE, AT_ONCE, SORTED = 1 << 20, 1 << 20, 4096
#: Bits of a place that hold the start; those above tell rows of one doc_id apart.
START_BITS = 40
U = np.uint64
_rng = np.random.default_rng(20_260_301)
CODES = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of them at least."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Entry i hashes the first i bytes; (h[j] - h[i]) * inverse power i depends on the bytes i to j alone."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(CODES[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return (h ^ (h >> U(29))) * U(0x94D049BB133111EB)


def smallest_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, v
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def contexts(pieces: list[bytes], least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their smallest gram: (hash of the gram, hash of the run, piece, first start, the gram's distance, windows)."""
    lens = np.array([len(p) for p in pieces])
    ends = np.cumsum(lens)
    begins = ends - lens
    data = np.frombuffer(b"".join(pieces), np.uint8)
    hashes, down = prefix_hashes(data), powers(len(data) + 1)[1]
    grams = mixed((hashes[gram:] - hashes[:-gram]) * down[: len(data) - gram + 1])
    place = U((1 << 22) - 1)
    best = (smallest_in_windows((grams & ~place) | np.arange(len(grams), dtype=U), least - gram + 1) & place).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), lens)[: len(best)]
    at = np.flatnonzero(np.arange(len(best)) + least <= ends[piece])
    new = np.ones(len(at), bool)
    new[1:] = (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else first
    q, n = best[first], last - first + 1
    whole = mixed((hashes[last + least] - hashes[first]) * down[first] + (q - first).astype(U) * U(0x632BE59BD9B4E019) + n.astype(U))
    return grams[q], whole, piece[first], first - begins[piece[first]], q - first, n


def joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (doc, at, n) in order, with those joined that follow on each other."""
    if not len(doc):
        return doc, at, n
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
    k = np.flatnonzero(new)
    return doc[k], at[k], np.add.reduceat(n, k)


def dealt(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc, tie, text) -> k, e, doc, at, shape: contexts by gram (k) and content (e); repeats seen within a batch have the shape -(windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts = numbers(batch, "doc"), numbers(batch, "tie"), batch.column(batch.schema.get_field_index("text"))
            found: list[tuple[np.ndarray, ...]] = []
            pieces, owner, start, held = [], [], [], 0

            def flush() -> None:
                nonlocal pieces, owner, start, held
                if pieces:
                    k, e, piece, first, left, n = contexts(pieces, least, gram)
                    row = np.array(owner)[piece]
                    found.append((k.view(np.int64), e.view(np.int64), ids[row], (ties[row].astype(np.int64) << START_BITS) + np.array(start)[piece] + first, left, n))
                pieces, owner, start, held = [], [], [], 0

            for row, text in enumerate(texts):
                data = (text.as_py() or "").encode()
                for a in range(0, len(data) - least + 1, PIECE):
                    pieces.append(data[a: a + PIECE + least - 1])
                    owner.append(row)
                    start.append(a)
                    held += len(pieces[-1])
                    if held >= AT_ONCE:
                        flush()
            flush()
            if not found:
                continue
            k, e, doc, at, left, n = (np.concatenate(c) for c in zip(*found, strict=True))
            # Of the contexts of this batch that are equal only the first goes on; the others are repeats already.
            order = np.lexsort((at, doc, e, k))
            again = np.zeros(len(k), bool)
            again[order[1:]] = (k[order[1:]] == k[order[:-1]]) & (e[order[1:]] == e[order[:-1]])
            gone = joined(doc[again], at[again], n[again])
            fresh = ~again
            columns = [
                np.concatenate([k[fresh], mixed(gone[0].view(U) + mixed(gone[1].view(U))).view(np.int64)]), np.concatenate([e[fresh], np.zeros(len(gone[0]), np.int64)]),
                np.concatenate([doc[fresh], gone[0]]), np.concatenate([at[fresh], gone[1]]), np.concatenate([left[fresh] << 20 | n[fresh], -gone[2]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "e", "doc", "at", "shape"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "k long, e long, doc long, at long, shape long")


def settled(rows: DataFrame, bucket: int) -> DataFrame:
    """Contexts of equal k and e met: kind 0 rows are repeated starts (doc, at, n), 1 the first contexts of grams with several, 2 those of grams with more than `bucket`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 4), np.int64)
        pending, last, hot = none, None, None  # first contexts of the gram that the last batch ended in

        def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(rows[:, c]) for c in (0, 1, 2)), pa.array(rows[:, 3] >> 20), pa.array(rows[:, 3] & ((1 << 20) - 1))], names=["kind", "k", "doc", "at", "left", "n"]
            )

        def of_runs(rows: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
            """Classifies complete grams; the last one stays pending unless whole."""
            nonlocal pending, hot
            edge = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
            size = np.diff(edge)
            large = size > bucket
            if len(size) and hot is not None and rows[0, 0] == hot:
                large[0] = True
            open_run = len(size) > 0 and not whole
            several = (size > 1) & ~large
            if open_run:
                several[-1] = False
            if several.any():
                yield out(1, rows[np.repeat(several, size)])
            if large.any():
                yield out(2, rows[np.repeat(large, size)])
            pending = none
            if open_run:
                if large[-1]:
                    hot = rows[-1, 0]
                else:
                    pending = rows[edge[-2]:].copy()

        for batch in batches:
            k, e, doc, at, shape = (numbers(batch, c) for c in ("k", "e", "doc", "at", "shape"))
            passed = shape < 0
            if passed.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(passed.sum(), np.int32)), *(pa.array(c[passed]) for c in (k, doc, at)), pa.array(np.zeros(passed.sum(), np.int64)), pa.array(-shape[passed])], names=["kind", "k", "doc", "at", "left", "n"]
                )
                k, e, doc, at, shape = (c[~passed] for c in (k, e, doc, at, shape))
            if not len(k):
                continue
            again = np.zeros(len(k), bool)
            again[1:] = (k[1:] == k[:-1]) & (e[1:] == e[:-1])
            again[0] = last == (k[0], e[0])
            last = (k[-1], e[-1])
            rows = np.stack([k, doc, at, shape], 1)
            if again.any():
                yield out(0, rows[again])
            yield from of_runs(np.concatenate([pending, rows[~again]]), False)
        yield from of_runs(pending, True)

    return rows.repartition("k").sortWithinPartitions("k", "e", "doc", "at").mapInArrow(run, "kind int, k long, doc long, at long, left long, n long")


def cut_out(docs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """The bytes of contexts: kind 1 with their bytes as u, kind 2 as one row per window, under two hashes of the whole window."""
    asked = found.where("kind > 0").withColumn("tie", F.shiftright("at", START_BITS)).groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "k", "at", "left", "n")).alias("asked"))
    start = (1 << START_BITS) - 1

    def make(batch: pa.RecordBatch) -> tuple[list[int], list]:
        rows, kind, k, e, at, shape, u = [], [], [], [], [], [], []
        lists = batch.column(batch.schema.get_field_index("asked"))
        texts = batch.column(batch.schema.get_field_index("text"))
        for row in range(batch.num_rows):
            data = (texts[row].as_py() or "").encode()
            part = lists[row].values
            c = {name: part.field(name).to_numpy(zero_copy_only=False) for name in ("kind", "k", "at", "left", "n")}
            for i in range(len(part)):
                a, n = int(c["at"][i]), int(c["n"][i])
                piece = data[(a & start): (a & start) + n - 1 + least]
                if c["kind"][i] == 1:
                    rows.append(row)
                    kind.append(np.array([1]))
                    k.append(c["k"][i: i + 1])
                    e.append(np.array([0]))
                    at.append(np.array([a]))
                    shape.append(np.array([int(c["left"][i]) << 20 | n]))
                    u.append(piece)
                    continue
                h = prefix_hashes(np.frombuffer(piece, np.uint8))
                h = (h[least:] - h[:n]) * powers(len(piece) + 1)[1][:n]
                rows += [row] * n
                kind.append(np.full(n, 2))
                k.append(mixed(h).view(np.int64))
                # Equal windows also share their gram and its place, so the two hashes together depend on 128 bits.
                e.append(mixed(mixed(h ^ U(int(c["k"][i]) & (1 << 64) - 1)) + (int(c["left"][i]) - np.arange(n)).astype(U)).view(np.int64))
                at.append(a + np.arange(n))
                shape.append(np.full(n, 1))
                u += [None] * n
        flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (kind, k, e, at, shape)]
        return rows, [*flat, u]

    return batched(docs.join(asked, ["doc", "tie"]), ["doc"], "kind long, k long, e long, at long, shape long, u binary", make)


# --- the suffix sort ------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of a buffer, compared up to `least` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, least: int):
        self.data, self.least = data, least
        self.hashes, self.down = prefix_hashes(data), powers(len(data) + 1)[1]

    def hashed(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.hashes[at + length] - self.hashes[at]) * self.down[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common extension of the suffixes at x and y, at most `least`, by binary search over prefix hashes."""
        out = np.full(len(x), self.least)
        todo = np.flatnonzero(self.hashed(x, self.least) != self.hashed(y, self.least))
        lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), self.least - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hashed(x[todo], mid) == self.hashed(y[todo], mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[todo] = lo
        return out

    def less(self, x: np.ndarray, y: np.ndarray, tie_x: np.ndarray, tie_y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        end = np.minimum(n, self.least - 1)
        a, b = self.data[x + end], self.data[y + end]
        return np.where((n == self.least) | (a == b), tie_x < tie_y, a < b)

    def sorted(self, at: np.ndarray, group: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The order of the suffixes within their groups, then by tie: a mergesort of all groups level by level."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(g)))
        start, end = np.repeat(begin, size), np.repeat(begin + size, size)
        width = 1
        while len(size) and width < size.max():
            i = np.flatnonzero(end - start > width)
            block = start[i] + (i - start[i]) // (2 * width) * (2 * width)
            middle, stop = np.minimum(block + width, end[i]), np.minimum(block + 2 * width, end[i])
            left = i < middle
            # An element's place is its own in its run, and the number of smaller ones in the other run.
            first = np.where(left, middle, block)
            lo, hi = first.copy(), np.where(left, stop, middle)
            x = order[i]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                y, z = order[mid], x[open_]
                smaller = self.less(at[y], at[z], tie[y], tie[z])
                lo[open_] = np.where(smaller, mid + 1, lo[open_])
                hi[open_] = np.where(smaller, hi[open_], mid)
            new = order.copy()
            new[block + (i - np.where(left, block, middle)) + (lo - first)] = x
            order = new
            width *= 2
        return order

    def verified(self, at: np.ndarray, group: np.ndarray, tie: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and which suffixes equal their predecessor; checked by the bytes, and sorted by them where a hash misled."""
        for _ in range(2):
            x, y = at[order[:-1]], at[order[1:]]
            same_group = group[order[:-1]] == group[order[1:]]
            equal, less = np.ones(len(x), bool), np.zeros(len(x), bool)
            for k in range(self.least):
                open_ = np.flatnonzero(equal & same_group)
                if not len(open_):
                    break
                a, b = self.data[x[open_] + k], self.data[y[open_] + k]
                less[open_[a < b]] = True
                equal[open_[a != b]] = False
            equal &= same_group
            sound = ~same_group | less | (equal & (tie[order[:-1]] < tie[order[1:]]))
            if sound.all():
                break
            rows = self.data[at[:, None] + np.arange(self.least)]
            order = np.lexsort((tie, *rows.T[::-1], group))
        return order, np.concatenate([[False], equal]) if len(order) else np.zeros(0, bool)


def repeated_windows(k: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, n: np.ndarray, u: list[bytes], least: int) -> np.ndarray:
    """Of all windows of some contexts (n each, in order), those that an equal window of the same gram precedes."""
    sizes = np.array([len(b) for b in u])
    suffixes = Suffixes(np.frombuffer(b"".join(u), np.uint8), least)
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = (np.cumsum(sizes) - sizes)[owner] + step
    out = np.zeros(len(owner), bool)
    # Equal windows have equal hashes, and their gram at the same distance; those without a companion need no sorting.
    key = mixed(mixed(suffixes.hashed(place, least) + k[owner].view(U)) + (left[owner] - step).astype(U))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    some = np.sort(order[same[1:] | same[:-1]])
    if not len(some):
        return out
    gram, distance = k[owner[some]], left[owner[some]] - step[some]
    by = np.lexsort((distance, gram))
    group = np.empty(len(some), np.int64)
    group[by] = np.cumsum(np.concatenate([[0], (gram[by[1:]] != gram[by[:-1]]) | (distance[by[1:]] != distance[by[:-1]])]))
    rank = np.empty(len(some), np.int64)
    rank[np.lexsort((at[owner[some]] + step[some], doc[owner[some]]))] = np.arange(len(some))
    order, equal = suffixes.verified(place[some], group, rank, suffixes.sorted(place[some], group, rank))
    out[some[order[equal]]] = True
    return out


def sorted_out(cut: DataFrame, least: int) -> DataFrame:
    """Repeated starts (doc, at, n) among contexts of equal grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["k"], SORTED):
            k, doc, at, shape = (numbers(rows, c) for c in ("k", "doc", "at", "shape"))
            n = shape & ((1 << 20) - 1)
            gone = repeated_windows(k, doc, at, shape >> 20, n, rows.column("u").to_pylist(), least)
            owner = np.repeat(np.arange(len(n)), n)[gone]
            start = at[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[gone]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in joined(doc[owner], start, np.ones(len(owner), np.int64))], names=["doc", "at", "n"])

    return cut.select("k", "doc", "at", "shape", "u").repartition("k").sortWithinPartitions("k").mapInArrow(run, "doc long, at long, n long")


def with_ties(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc, tie) of all rows, and (doc, tie, text), one a document: tie tells the texts that share a doc_id apart."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"))
    text = F.col("row")["text"]
    if rows.groupBy("doc").count().where("count > 1").first() is None:
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
        return rows, rows.select("doc", "tie", text.alias("text"))
    key = ["doc", "h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64(F.coalesce(text, F.lit(""))), "h2": F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))})
    numbered = rows.select(*key).distinct().withColumn("tie", F.row_number().over(Window.partitionBy("doc").orderBy("h1", "h2")).cast("long") - 1)
    rows = rows.join(numbered, key).select("row", "doc", "tie")
    return rows, rows.select("doc", "tie", text.alias("text")).dropDuplicates(["doc", "tie"])


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """docs with n_bytes, spans (array of start and end: the removed bytes) and kept (the bytes that stay).

    gram: bytes of the grams that deal windows, fewer than least; bucket: contexts of a gram that one task sorts.
    """
    rows, single = with_ties(docs)
    found = written(settled(dealt(single, least, gram), bucket), "repeats")
    cut = written(cut_out(single, found, least), "contexts")
    gone = found.where("kind = 0").select("doc", "at", "n").unionByName(sorted_out(cut.where("kind = 1"), least)).unionByName(
        settled(cut.where("kind = 2").select("k", "e", "doc", "at", "shape"), bucket).where("kind = 0").select("doc", "at", "n")
    )
    per_doc = gone.select("doc", F.shiftright("at", START_BITS).alias("tie"), F.struct(F.col("at").bitwiseAND((1 << START_BITS) - 1).alias("a"), "n").alias("r"))
    ranges = written(per_doc.groupBy("doc", "tie").agg(F.collect_list("r").alias("ranges")), "ranges")
    drop_written(found, cut)

    def make(batch: pa.RecordBatch) -> tuple[None, list]:
        sizes, spans, kept = [], [], []
        texts, lists = batch.column(batch.schema.get_field_index("row")).field("text"), batch.column(batch.schema.get_field_index("ranges"))
        for row in range(batch.num_rows):
            data = (texts[row].as_py() or "").encode()
            sizes.append(len(data))
            if not lists[row].is_valid:
                spans.append([])
                kept.append(data)
                continue
            part = lists[row].values
            a, n = part.field("a").to_numpy(), part.field("n").to_numpy()
            order = np.argsort(a, kind="stable")
            begin, end = a[order], np.maximum.accumulate((a + n - 1 + least)[order])
            new = np.concatenate([[True], begin[1:] > end[:-1]])
            begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(begin, end, strict=True)])
            kept.append(b"".join(data[x:y] for x, y in zip(np.append(0, end), np.append(begin, len(data)), strict=True)))
        return None, [sizes, spans, kept]

    made = ["n_bytes", "spans", "kept"]
    out = batched(rows.join(ranges, ["doc", "tie"], "left").select("row", "ranges"), ["row"], "n_bytes long, spans array<struct<start: long, end: long>>, kept binary", make)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *made)
