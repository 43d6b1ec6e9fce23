"""Suffix-sort removal, whitening and hard negatives against brute force and edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import negatives, queries, suffixes, whitening


# --- 11 suffix sort -----------------------------------------------------------------------------


def plain_removal(texts, least):
    """For texts in document order: the bytes that a repeated string of `least` bytes covers."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            w = data[p: p + least]
            if w in seen:
                gone[p: p + least] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((len(data), spans, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def removal(docs, **settings):
    return {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.without_repeats(docs, **settings).collect()}


@pytest.mark.parametrize("seed, bucket", [(0, 2048), (1, 3), (2, 1)])
def test_repeats_against_brute_force(spark, seed, bucket):
    rng = np.random.default_rng(seed)
    words = ["ab", "ba", "aab", "x", "é", "漢"]
    line = "the common line of many texts"
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(60)]
    texts += [t[int(rng.integers(0, 9)):] + line + str(rng.integers(0, 99)) for t in texts[:30]] + texts[:5] + ["a" * 300, "ab" * 200, None, "", "short", line, line[:11]]
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), texts[i]) for i in order], "doc_id long, text string").repartition(3)
    got, want = removal(docs, least=12, gram=5, bucket=bucket), plain_removal(texts, 12)
    assert got == dict(enumerate(want))


def test_repeats_across_the_pieces_of_a_long_text(spark):
    rng = np.random.default_rng(8)
    long = "".join(rng.choice(list("abcdefgh "), suffixes.PIECE + 5000))
    moved = "z" * 777 + long[100: suffixes.PIECE + 900] + "end"
    docs = spark.createDataFrame([(1, long), (2, moved), (3, "x" * 40_000)], "doc_id long, text string")
    assert removal(docs) == dict(zip((1, 2, 3), plain_removal([long, moved, "x" * 40_000], 100)))


def test_repeats_edges(spark):
    a, b = "first text of one id, long enough", "second text of one id, long enough"
    rows = [(1, a, 7, 0, "k"), (1, b, 7, 1, "k"), (1, a, 7, 2, "k"), (None, a, 7, 3, "k"), (2, None, 7, 4, "k"), (3, "tiny", 7, 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie int, n int, kept string")
    out = suffixes.without_repeats(docs, 12, 5)
    assert out.columns == ["doc_id", "text", "tie", "n", "n_bytes", "spans", "kept"]
    got = {r["n"]: r for r in out.collect()}
    assert len(got) == 6 and all(r["tie"] == 7 for r in got.values())
    # Rows that agree in id and text are one document; the row without an id comes last, so all of it repeats.
    assert got[0]["kept"] == got[2]["kept"] and got[3]["kept"] == b"" and got[4]["n_bytes"] == 0 and got[5]["kept"] == b"tiny"
    # Of the two texts of id 1 the one of the smaller hash is first: the other loses what they share.
    assert {len(got[0]["kept"]) == len(a), len(got[1]["kept"]) == len(b)} == {True, False}
    assert suffixes.without_repeats(docs.where("false")).count() == 0


def test_suffix_order_equals_the_bytes_order():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at, group, least = rng.choice(2900, 900, replace=False), rng.integers(0, 5, 900), 20
    tie = rng.permutation(900)
    s = suffixes.Suffixes(data, least)
    want = sorted(range(900), key=lambda i: (group[i], data[at[i]: at[i] + least].tobytes(), tie[i]))
    order = s.sorted(at, group, tie)
    assert order.tolist() == want
    # Where hashes collide throughout, the check by bytes sees it and sorts anew.
    s.hashes = np.zeros_like(s.hashes)
    wrong = s.sorted(at, group, tie)
    assert wrong.tolist() != want
    order, equal = s.verified(at, group, tie, wrong)
    assert order.tolist() == want
    strings = [(group[i], data[at[i]: at[i] + least].tobytes()) for i in order]
    assert equal.tolist() == [False, *(a == b for a, b in zip(strings, strings[1:]))]


def test_op11_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = plain_removal([r["text"] for r in docs], 100)
    got = {r["doc_id"]: r for r in queries.op11_suffix_sort(spark, sf).collect()}
    for r, (n, spans, kept) in zip(docs, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(len(w[1]) for w in want) > 0 and len(got) == len(docs)


# --- 12 whitening -------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "cluster", "rank one", "diagonal", "small", "one"])
def test_leading_components(kind):
    rng = np.random.default_rng(6)
    n = {"small": 2, "one": 1}.get(kind, 40)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = {"cluster": np.r_[[5, 5, 5 - 1e-9, 5 - 1e-7], np.linspace(1, 0, n - 4)] if n == 40 else None, "rank one": np.r_[3.0, np.zeros(n - 1)], "diagonal": np.arange(n, 0, -1.0)}.get(kind, np.sort(rng.random(n))[::-1])
    v = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    v = (v + v.T) / 2
    e, c = whitening.leading(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(e, want, atol=1e-13 * max(1, want[0]))
    assert np.allclose(c @ c.T, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ c.T - c.T * e).max() < 1e-12 * max(1, want[0])


def plain_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    v = y.T @ y / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:4], c[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ c / np.sqrt(e), e / np.trace(v)


def test_op12_against_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, w, explained = plain_whitening(np.floor(256 * np.array([r["embedding"] for r in rows])).astype(np.int64))
    got = queries.op12_whitening(spark, sf).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in got] == [1, 2, 3, 4] * len(rows) and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::4]] == deviation.tolist()
    assert np.allclose(np.abs([r["whitened"] for r in got]), np.abs(w).ravel(), atol=1e-10)
    assert np.allclose([r["explained"] for r in got[:4]], explained) and max(r["identity_error"] for r in got) < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-500, 500, (30, 5))
    rows = [(i, (v / 256).tolist(), "x") for i, v in enumerate(base)] + [(3, (base[3] / 256).tolist(), "x"), (None, (base[4] / 256).tolist(), "x")]
    odd = [(90, None, "x"), (91, [], "x"), (92, [1.0, None, 1.0, 1.0, 1.0], "x"), (93, [float("nan")] * 5, "x"), (94, [float("inf")] * 5, "x"), (95, [1.0], "x")]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(frame(rows + odd)).collect()
    n, deviation, w, explained = plain_whitening(base)
    assert len(got) == 4 * 32 and {r["n"] for r in got} == {30} and max(r["identity_error"] for r in got) < 1e-9
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert all(by[i, 1]["deviation"] == deviation[i] for i in range(30)) and by[None, 2]["whitened"] == by[4, 2]["whitened"]
    assert np.allclose(np.abs([[by[i, k]["whitened"] for k in range(1, 5)] for i in range(30)]), np.abs(w))
    # Equal vectors have no variance; two points have one component with some; a huge entry's deviation is beyond a long.
    same = whitening.whiten(frame([(1, [0.5, 0.5], "x"), (2, [0.5, 0.5], "x")])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    two = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame([(1, [0.0, 0.0], "x"), (2, [1e9, 1e9], "x")])).collect()}
    assert abs(abs(two[1, 1]["whitened"]) - 1) < 1e-12 and two[1, 2]["whitened"] is None and two[1, 1]["deviation"] is None and two[1, 1]["explained"] == pytest.approx(1)
    assert whitening.whiten(frame(odd[:5])).count() == 0 and whitening.whiten(frame([]).limit(0)).count() == 0


def test_sums_are_exact_beyond_doubles(spark):
    x = [[(1 << 62) + i, -(1 << 62) - i, i] for i in range(40)]
    n, sums = whitening.summed_exactly(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3))
    assert n == 40 and sums == [sum(c) for c in zip(*x)]


# --- 13 hard negatives --------------------------------------------------------------------------


def plain_negatives(rows, is_anchor):
    """rows: id -> (label, vector of whole numbers)."""
    out = []
    for a, (label, x) in rows.items():
        if not is_anchor(a):
            continue
        scored = sorted(((-int(np.dot(x, y)), b, other) for b, (other, y) in rows.items() if b != a and len(y) == len(x)))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, positive, k + 1, b, -p, -s) for k, (s, b, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("seed, spread", [(1, 3), (2, 400), (3, 1)])
def test_hard_negatives_against_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    rows = {i: (int(rng.integers(0, 3)), rng.integers(-spread, spread + 1, 6)) for i in range(150)}
    rows |= {200 + i: (1, rows[0][1]) for i in range(20)} | {300: (2, np.zeros(6, int)), 400: (0, np.array([3, 1])), 401: (1, np.array([3, 1])), 402: (0, np.array([3, 2]))}
    frame = spark.createDataFrame([(i, (np.asarray(x) / 256).tolist(), label, "k") for i, (label, x) in rows.items()], "vec_id long, embedding array<double>, label int, id string")
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert want
    for sizes in ({}, {"block": 40, "anchor_block": 7}):
        got = negatives.hard_negatives(frame, F.col("id") % 10 == 0, **sizes)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_edges(spark):
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, label int")
    run = lambda r: sorted(tuple(x) for x in negatives.hard_negatives(frame(r), F.col("id") % 100 == 0).collect())
    good = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 2)]
    odd = [(None, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 2), (7, [], 2), (8, [1.0, None], 2), (9, [float("nan"), 0.0], 2), (10, [float("inf"), 0.0], 2), (11, [1.0], 2)]
    want = [(0, 1, 1, 2, 256 * 256, 230 * 256)]
    assert run(good + odd + good) == want and run([]) == [] and run(odd) == [] and run(good[:1]) == []
    # Entries far beyond any embedding are held to the bound of their width, here floor(sqrt(2^55)).
    bound = 189_812_531
    assert run([(0, [1e300, 0.0], 1), (1, [1e300, 0.0], 1), (2, [1e299, 1.0], 2)]) == [(0, 1, 1, 2, bound**2, bound**2)]


def test_threshold_stops_early_and_keeps_ties():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (4000, 3)).astype(float)
    lists = negatives.Lists(np.arange(4000)[::-1].copy(), x)
    anchor = np.array([3.0, 0.0, -2.0])
    score = x @ anchor
    (ids, scores), (ids2, scores2) = lists.best(anchor, -1, np.array([-np.inf, 50.0]), np.array([np.inf, 60.0]), 7)
    order = sorted(range(4000), key=lambda k: (-score[k], lists.ids[k]))
    assert ids.tolist() == [int(lists.ids[k]) for k in order[:7]] and scores.tolist() == [score[k] for k in order[:7]]
    inside = [k for k in order if 50 <= score[k] <= 60][:7]
    assert ids2.tolist() == [int(lists.ids[k]) for k in inside] and scores2.tolist() == [score[k] for k in inside]


def test_op13_against_brute_force(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows[r["vec_id"]] = (label, np.floor(256 * np.array(r["embedding"])).astype(np.int64))
    got = queries.op13_hard_negatives(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 100 == 0)
