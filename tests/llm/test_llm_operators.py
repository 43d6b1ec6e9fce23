"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.llm import audio, chat, crosspolytope, graph, licenses, overlap, packing, pieces, pii, queries, simhash, toxicity, warc

RANKS, BPE, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Null, empty, blank, repeated, tied and very long texts, and a column whose name clashes.
TEXTS = [None, "", " \n\t ", "one", "one two", "same text here now", "same text here now", "x" * 30_000, "word " * 20_000, "Ünï çødé 漢字 😀 mixed", "a\x00b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 7, 0.5, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 7, 0.5, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id int")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- components ---------------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(50)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs + [(None, 3), (4, None)], "a long, b long")).collect()}
    want = components(400, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 toxicity ---------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    plain = ["stone", "river", "letter", "garden", "window", "paper", "summer", "number", "people", "market"]
    bad = ["idiot", "moron", "scum", "worthless", "loser"]
    rows, labels = [], []
    for i in range(n):
        words = [*rng.choice(plain, 25), *(rng.choice(bad, 2) if i % 4 == 0 else [])]
        rng.shuffle(words)
        rows.append((i, " ".join(map(str, words)) + f" n{i}"))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(9999, None)], "doc_id long, toxic int")


def test_toxicity_learns_and_restores(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    held = docs.where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert sum((model.score(r["text"]) >= 0.3) == bool(r["toxic"]) for r in held) / len(held) > 0.97
    for text in ("you 1d10t", "m0r0n!", "$cum", "i d i o t", "i.d.i.o.t", "idiooooot", "l0ser", "w0rthless***", "mоron", "m*ron", "m*r*n", "|d|0t", "ｍｏｒｏｎ", "m-o-r-o-n" + "-x" * 30, "http://example.com/" + "a/b-c/" * 12 + "m0r0n"):
        assert model.score(text) >= 0.3, text
    for text in ("stone river", "a b c d", "1984", "paper@market.com", None, ""):
        assert model.score(text) < 0.3, text


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).lexicon == toxicity.fit(docs, flipped).lexicon


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.scored(odd, toxicity.fit(odd, labels))
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and set(odd.columns) <= set(out.columns)
    empty = odd.limit(0)
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_long_tokens_and_cut_words(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    plain = "_".join(["r1v3r", "st0ne", "l3tter", "gard3n"] * 4)
    bad = [f"{plain}_y0u_4r3_a_1d10t_{plain}", ".".join("riverstoneletteridiotgardenwindowpapersummer"), "-".join(["river"] * 20 + ["m0r0n"]), "id.iot", "i-di-ot", "id\u200biot", "you-id.iot"]
    assert all(len(t) > 64 for t in bad[:3]) and not [t for t in bad if model.score(t) < 0.3]
    assert model.score(plain) < 0.3 and model.score("river-stone") == pytest.approx(toxicity.BASE)


def best_path(model, observed):
    """The decoder by trying every reading of a short word."""
    code = {c: k + 1 for k, c in enumerate(toxicity.LETTERS)}
    readings = [("", 0.0)]
    for c in observed:
        options = [(c, 0.0)] if c in code else [(x, toxicity.SUBSTITUTED) for x in toxicity.LEET[c]] + [(c, toxicity.LITERAL) if c.isalnum() else ("", toxicity.SKIPPED)]
        readings = [(t + o, s + k) for t, s in readings for o, k in options]

    def total(text, cost):
        p = q = 0
        for x in text:
            k = code.get(x, 0)
            if k or q:
                cost += model.logp[p][q][k]
            p, q = (q, k) if k else (0, 0)
        return cost + (model.logp[p][q][0] if q else 0.0)

    return max((total(t, s), t) for t, s in readings)[1]


@pytest.mark.parametrize("seed", range(3))
def test_toxicity_of_whole_texts_against_brute_force(spark, seed):
    """Every reading of every written-over word is tried; the score is the noisy-or of the lexicon's entries found."""
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    rng = np.random.default_rng(seed)
    write = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}
    pool = ["stone", "river", "letter", "garden", "window", "paper", "idiot", "moron", "scum", "worthless", "people"]
    texts, want = [], []
    for _ in range(60):
        tokens, hits = [], set()
        for w in rng.choice(pool, int(rng.integers(0, 12))):
            t = "".join(write[c] if c in write and rng.random() < 0.5 else c for c in str(w))
            if re.search(r"(.)\1", t):
                t = str(w)
            tokens.append(t)
            read = t if t.isalpha() else best_path(model, t)
            hits.update(f for f in toxicity.features(read) if f in model.lexicon)
        texts.append(" ".join(tokens))
        miss = 1 - toxicity.BASE
        for f in sorted(hits):
            miss *= 1 - model.lexicon[f]
        want.append(1 - miss)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)
    assert {x >= 0.3 for x in want} == {True, False}


def test_toxicity_viterbi_is_exact(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    for word in ("1d10t", "m0r0n", "p@p3r", "w1nd0w", "$t0n3", "l3tt3", "6ard3n"):
        if not re.search(r"(.)\1", word):
            assert model.decode(word) == best_path(model, word), word


# --- 2 embeddings -------------------------------------------------------------------------------


def test_cross_polytope_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 24)), base[:5], 3 * base[5:8], base[9:10] + 0.04 * rng.normal(size=(80, 24))]).astype(np.float32)
    rows = [(int(i), [float(v) for v in e], 0) for i, e in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [1.0, None] + [0.0] * 22, 0), (904, [], 0), (905, [1.0] * 10, 0), (906, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = d @ d.T >= 0.95
    np.fill_diagonal(near, False)
    comp = components(len(x), list(zip(*np.nonzero(near), strict=True)))
    for block in (1024, 16):
        got = {r["vec_id"]: r for r in crosspolytope.near_vectors(df, block=block).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == comp
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
    assert crosspolytope.near_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = crosspolytope.hadamard(np.eye(16)) / 4
    assert np.allclose(h @ h.T, np.eye(16))


# --- 3 pieces -----------------------------------------------------------------------------------


def slow_encoding(p, text):
    """Unigram Viterbi with a dictionary and no automaton."""
    known = {p.text[i]: i for i in range(len(p.text))}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    x = "▁" + text.replace(" ", "▁")
    best = [0.0] + [float("-inf")] * len(x)
    for end in range(1, len(x) + 1):
        best[end] = best[end - 1] + p.unknown
        for size in range(1, min(16, end) + 1):
            i = known.get(x[end - size: end])
            if i is not None and not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                best[end] = max(best[end], best[end - size] + model.get_score(i))
    return best[-1]


def test_pieces_score_and_round_trip(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = pieces.pieces_of(MODEL)
    for text in ("Hello world", "Ünï çødé", "a b  c", "line\nbreak 漢字 😀", "The quick brown fox", "x"):
        ids = p.encode(text)
        chars = len(re.findall(r"(?:<0x..>)+", "".join(p.text[i] for i in ids)))
        total = sum(model.get_score(i) for i in ids if i not in p.byte_of)
        unknown = sum(1 for c in "▁" + text.replace(" ", "▁") if c not in p.automaton) if chars else 0
        assert total + unknown * p.unknown == pytest.approx(slow_encoding(p, text))
        assert p.decode(ids) == text
    out = pieces.coded(documents, MODEL)
    assert out.where("not round_trip").count() == 0


def unigram_model():
    """The same pieces and scores, declared as a unigram model."""
    data = open(MODEL, "rb").read()

    def fields(b):
        at = 0
        while at < len(b):
            start, tag, shift = at, 0, 0
            while True:
                tag |= (b[at] & 127) << shift
                shift += 7
                at += 1
                if b[at - 1] < 128:
                    break
            kind = tag & 7
            if kind == 2:
                n, shift = 0, 0
                while True:
                    n |= (b[at] & 127) << shift
                    shift += 7
                    at += 1
                    if b[at - 1] < 128:
                        break
                yield tag >> 3, start, at, at + n
                at += n
            elif kind == 0:
                begin = at
                while b[at] >= 128:
                    at += 1
                at += 1
                yield tag >> 3, start, begin, at
            else:
                yield tag >> 3, start, at, at + (4 if kind == 5 else 8)
                at += 4 if kind == 5 else 8

    out = bytearray(data)
    for number, _, a, b in fields(data):
        if number == 2:
            for inner, _, c, _ in fields(data[a:b]):
                if inner == 3:
                    out[a + c] = 1
    return bytes(out)


def test_pieces_equal_the_library_reading_them_as_unigram(documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model())
    p = pieces.pieces_of(MODEL)
    words = sorted({w for r in documents.select("text").collect() for w in (r["text"] or "").split()})[:3000]
    words = [w for w in words if "▁" not in w]
    want = library.encode(words)
    got = [p.encode(w) for w in words]
    assert sum(a == b for a, b in zip(got, want, strict=True)) / len(words) > 0.999


def test_pieces_edges(spark, odd):
    rows = {r["doc_id"]: r for r in pieces.coded(odd, MODEL).collect()}
    assert rows[0]["n_ids"] == rows[1]["n_ids"] == 0 and all(r["round_trip"] for r in rows.values())
    assert pieces.decoded(pieces.encoded(odd, MODEL), MODEL).where("doc_id = 9").first()["text"] == TEXTS[9]
    assert pieces.coded(odd.limit(0), MODEL).count() == 0


# --- 4 simhash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    comp = components(len(ids), pairs)
    smallest = {}
    for i, c in zip(ids, comp, strict=True):
        smallest[c] = min(i, smallest.get(c, i))
    for limit in (50_000, 3):
        got = {r["doc_id"]: r for r in simhash.simhash_components(docs, limit=limit).collect()}
        for i, p, c in zip(ids, prints, comp, strict=True):
            assert got[i]["fp"] & (2**64 - 1) == p and got[i]["component_id"] == smallest[c]


def test_trie_finds_exactly_the_near_values(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (12, 2))], *[base ^ np.uint64(7)]]))
    found = [tuple(sorted((int(i), int(j)))) for x, y in simhash.walk_pairs(values, 64, np.array([[0, len(values), 0, len(values), 0, 0]]), 3) for i, j in zip(x, y, strict=True)]
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == want


def test_split_nodes_keep_every_near_pair(spark):
    rng = np.random.default_rng(7)
    base, bits, budget = 0x0123456789ABCDEF, 64, 2
    low = {base ^ sum(1 << int(b) for b in rng.choice(12, int(rng.integers(0, 5)), replace=False)) for _ in range(900)}
    values = sorted(low | {v ^ (1 << 60) for v in low if rng.random() < 0.3})
    fps = spark.createDataFrame(list(enumerate(values)), "rep long, v long")
    nodes = {}
    for r in simhash.split_nodes(simhash.rotations(fps, bits, budget), bits, budget, 50).collect():
        nodes.setdefault(tuple(r[c] for c in ("turn", "node_a", "node_b", *simhash.NODE)), ([], []))[r["side"]].append(r["rep"])
    met = {}
    for (turn, a, b, *_), (left, right) in nodes.items():
        pairs = [(x, y) for x in left for y in right] if a != b else [(x, y) for x in left for y in left if x < y]
        met.setdefault(turn, set()).update((min(p), max(p)) for p in pairs)
    edges = [round(k * bits / (budget + 1)) for k in range(budget + 2)]
    near = [(i, j, values[i] ^ values[j]) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= budget]
    for k in range(budget + 1):
        block = ((1 << bits - edges[k]) - 1) & ~((1 << bits - edges[k + 1]) - 1)
        assert not {(i, j) for i, j, x in near if not x & block} - met[k]


def test_split_nodes_drop_children_of_one_side(spark):
    rng = np.random.default_rng(8)
    values = sorted({int(v) for v in rng.integers(0, 2**62, 60)} | {77 ^ (1 << k) for k in range(40)})
    rows = simhash.split_nodes(simhash.rotations(spark.createDataFrame(list(enumerate(values)), "rep long, v long"), 64, 2), 64, 2, 10)
    split = rows.where("node_a <> node_b").groupBy(*simhash.NODE).agg(F.count_distinct("side").alias("sides"))
    assert split.count() and split.where("sides < 2").count() == 0


def test_windows_of_many_rows_are_dealt_to_blocks(spark):
    rng = np.random.default_rng(9)
    most, limit, n = 20, 40, 600
    centres = rng.integers(-(2**63), 2**63 - 1, (5, 4))
    prints = []
    for k in range(n):
        c = [int(x) for x in centres[min(k % 9, 4)]]
        for b in rng.integers(0, 192, int(rng.integers(0, 14))):
            c[1 + int(b) // 64] ^= (1 << int(b) % 64) - ((1 << 64) if int(b) % 64 == 63 else 0)
        prints.append([5 ^ k % 3, *c[1:]])
    bits = np.array(prints, np.int64).view(np.uint64)
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
    same = bits[:, None, 0] == bits[None, :, 0]  # rows behind one leaf are candidates whatever else differs
    want = components(n, [(int(i), int(j)) for i, j in zip(*np.nonzero((far <= most) | same), strict=True) if i > j])
    rows = spark.createDataFrame([(0, i, *p) for i, p in enumerate(prints)], ["window", "rep", *simhash.SKETCH])
    for size in (limit, n):
        blocks = simhash.window_blocks(rows, most, 18, size)
        assert blocks.groupBy(*simhash.WINDOW).count().agg(F.max("count")).first()[0] <= max(4 * limit, size)
        got = {r["id"]: r["component"] for r in graph.connected_components(simhash.window_links(blocks, 18, most)).collect()}
        assert size == limit or [got.get(i, i) for i in range(n)] == want


def shingles(text, words=5):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(parts[i: i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else {""}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited_texts(rng, n, edits, words=150):
    """Copies of one text, each with some words replaced by ones of its own."""
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for k in range(n):
        c = list(base)
        for at in rng.choice(words, int(rng.integers(1, edits)), replace=False):
            c[at] = f"own{k}x{at}"
        out.append(" ".join(c))
    return out


def test_exact_links_against_brute_force(spark):
    import xxhash

    rng = np.random.default_rng(11)
    families = [edited_texts(rng, 70, 9), edited_texts(rng, 3, 4), edited_texts(rng, 1, 3), ["only one"], edited_texts(rng, 40, 25)]
    texts = [(f, t) for f, ts in enumerate(families) for t in ts]
    made = [(i, f, bytearray(np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(t)], np.uint64)).tobytes())) for i, (f, t) in enumerate(texts)]
    sets = spark.createDataFrame(made + [(900, None, bytearray(8)), (901, 0, bytearray())], "rep long, family long, h binary")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] == texts[j][0] and jaccard(shingles(texts[i][1]), shingles(texts[j][1])) >= 0.8]
    want = components(len(texts), pairs)
    for block in (512, 20, 7):
        got = {r["id"]: r["component"] for r in graph.connected_components(overlap.exact_links(sets, 0.8, block)).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == want, block
    assert overlap.exact_links(sets.limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200)))).astype(np.uint64) for _ in range(40)]
    got = overlap.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_similar_texts_meet(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    texts = [list(map(str, rng.choice(words, 200))) for _ in range(40)]
    copies = []
    for t in texts[:15]:
        c = list(t)
        c[int(rng.integers(20, 180))] = "changed"
        copies.append(c)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, *copies])] + [(900, None), (901, ""), (None, "x"), (902, "Two words"), (903, "two  WORDS")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert all(got[40 + i] == i for i in range(15)) and all(got[i] == i for i in range(40)) and got[901] == 900 and got[903] == 902 and None not in got


def test_similar_groups_are_exactly_those_of_brute_force(spark, documents):
    rng = np.random.default_rng(13)
    own = [t for _ in range(60) for t in edited_texts(rng, 3, 6, 120)] + edited_texts(rng, 150, 9)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    rows = sorted((r["doc_id"], shingles(r["text"])) for r in docs.collect())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (s := jaccard(rows[i][1], rows[j][1])) >= 0.8]
    want = [rows[c][0] for c in components(len(rows), near)]
    for limit, block in ((2048, 512), (30, 40)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs, limit=limit, block=block).collect()}
        have = [got[i] for i, _ in rows]
        split = sum(have[i] != have[j] for i, j in near)
        assert split / len(near) < 0.01
        # Nothing below the similarity is joined: each group found lies in a group of brute force.
        assert len({(a, b) for a, b in zip(have, want, strict=True)}) == len(set(have))


# --- 5 audio ------------------------------------------------------------------------------------


def test_telephony_round_trip(spark, odd):
    rows = {r["doc_id"]: r for r in audio.texts_as_audio(odd).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        padded = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[5]["feature"] == rows[6]["feature"] and audio.texts_as_audio(odd.limit(0)).count() == 0


def test_law_tables_and_adpcm():
    assert audio.MU[0xFF] == 0 and audio.MU[0x00] == -32124 and audio.MU[0x80] == 32124 and audio.A[0xD5] == 8 and audio.A[0x55] == -8
    assert audio.A[0x2A] == -32256 and audio.A[0xAA] == 32256
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (50, 64)).astype(np.uint8)
    got = audio.adpcm_blocks(blocks)
    for b, g in zip(blocks[:10], got, strict=False):
        value, index = int.from_bytes(bytes(b[:2]), "little", signed=True), min(int(b[2]), 88)
        out = [value]
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(audio.STEP[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(audio.INDEX_MOVES[code & 7])))
                out.append(value)
        assert g.tolist() == out


def test_adpcm_coded_sound_is_kept():
    t = np.arange(1010) / 8000
    tone = (6000 * np.sin(2 * np.pi * 300 * t)).astype(np.int16).reshape(10, 101)
    blocks = audio.adpcm_coded(tone)
    assert blocks.shape == (10, 54) and np.abs(audio.adpcm_blocks(blocks).astype(int) - tone).max() < 700
    media = audio.wave(audio.IMA_ADPCM, blocks.tobytes(), bits=4, align=54)
    tag, rate, align, data = audio.parse_wave(media)
    assert (tag, rate, align) == (audio.IMA_ADPCM, 8000, 54) and np.array_equal(audio.expand(tag, align, data), audio.adpcm_blocks(blocks).ravel())


def test_long_sounds_have_no_seams():
    rng = np.random.default_rng(6)
    sound = rng.integers(-8000, 8000, 3 * audio.SAMPLES_AT_ONCE + 1234).astype(np.int16)
    for up, down in ((1, 4), (3, 8), (3, 4), (2, 1)):
        assert np.array_equal(audio.resampled(sound, up, down), audio._resampled(sound, up, down, 8))


def test_stored_sounds_are_the_expanded_one(spark, odd):
    stored = audio.store_texts(odd)
    out = {(r["doc_id"], r["n_bytes"]): r for r in audio.media_features(stored).collect()}
    for r in stored.collect():
        want = audio.resampled(audio.MU[np.frombuffer(audio.parse_wave(bytes(r["media"]))[3], np.uint8)], 3, 4)
        done = out[r["doc_id"], r["n_bytes"]]
        tag, rate, align, data = audio.parse_wave(bytes(done["pcm"]))
        assert (tag, rate) == (audio.PCM, 6000) and np.array_equal(np.frombuffer(data, "<i2"), want)
        # The ADPCM file holds the same sound: each block begins with its sample, and steps follow it as far as they reach.
        tag, rate, align, data = audio.parse_wave(bytes(r["adpcm"]))
        assert (tag, rate, align, audio.sample_count(bytes(r["adpcm"]))) == (audio.IMA_ADPCM, 6000, 64, len(want))
        read = audio.expand(tag, align, data)
        assert len(read) >= len(want) > len(read) - audio.PER_BLOCK and np.array_equal(read[: len(want): audio.PER_BLOCK], want[:: audio.PER_BLOCK])
        assert f"adpcm6000={audio.level(read[: len(want)])}" in done["feature"] and f"pcm6000={audio.level(want)}" in done["feature"]


def test_speech_like_sound_survives_adpcm():
    t = np.arange(20_000) / 6000
    tone = (5000 * np.sin(2 * np.pi * 220 * t) + 1500 * np.sin(2 * np.pi * 700 * t)).astype(np.int16)
    for sound in (tone, tone[:1], tone[:121], tone[:122], tone[:0]):
        media, = audio.adpcm_files([sound], 6000)
        tag, _, align, data = audio.parse_wave(media)
        read = audio.expand(tag, align, data)[: audio.sample_count(media)]
        assert len(read) == len(sound)
    media, = audio.adpcm_files([tone], 6000)
    read = audio.expand(audio.IMA_ADPCM, 64, audio.parse_wave(media)[3])[: len(tone)].astype(float)
    assert np.square(read - tone).mean() < 0.02 * np.square(tone.astype(float)).mean()


def test_resampling_keeps_a_tone(spark):
    t = np.arange(8000) / 8000
    tone = (8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    up = audio.resampled(tone, 2, 1)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(up) == 16000 and np.abs(up[200:-200] - want[200:-200]).max() < 80
    media = spark.createDataFrame([(1, bytearray(audio.wave(audio.MU_LAW, b"\xff" * 100))), (2, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in audio.decoded(media, 2, 1).collect()}
    assert got[1]["rate"] == 16000 and got[2]["pcm"] is None and len(audio.parse_wave(bytes(got[1]["pcm"]))[3]) == 400
    with pytest.raises(ValueError):
        audio.parse_wave(b"RIFF")


# --- 6 pii --------------------------------------------------------------------------------------

PRIVATE = "call +1 (743) 555-3824 or 743-555-3824, card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112, ip 8.196.197.208, born 1980-02-29, ssn 123-45-6789, mail joe.x@mail5.example.com!"


def test_pii_links_undoes_and_keeps_formats(spark, odd):
    docs = spark.createDataFrame([(1, PRIVATE), (2, "again 4111-1111-1111-1111 on 8.196.197.208")], "doc_id long, text string")
    hidden = pii.pseudonymized(docs, "k")
    a, b = (r["text"] for r in hidden.orderBy("doc_id").collect())
    for value in ("743", "4111 1111 1111 1111", "4111111111111111", "8.196.197.208", "1980-02-29", "123-45-6789", "joe.x"):
        assert value not in a.replace("4111111111111112", ""), value
    assert "4111111111111112" in a and "@mail5.example.com" in a
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"card ([\d ]+\d) and (\d+)", a)[0]]
    assert digits[0] == digits[1] == re.sub(r"\D", "", re.search(r"again ([\d-]+)", b)[1])
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(digits[0]))
    assert total % 10 == 0
    assert re.search(r"ip ([\d.]+\d)", a)[1] == re.search(r"on ([\d.]+)$", b)[1]
    back = pii.pseudonymized(hidden, "k", undo=True).where("doc_id = 1").first()["text"]
    assert back == PRIVATE.replace("joe.x", re.search(r"mail (\w+)@", a)[1])
    assert pii.pseudonymized(docs, "other").first()["text"] != a
    same = {r["doc_id"]: r["text"] for r in pii.pseudonymized(odd, "k").collect()}
    assert all(same[i] == t for i, t in enumerate(TEXTS)) and pii.pseudonymized(odd, "k").columns == odd.columns


def test_pii_short_addresses_alone_and_beside_a_date(spark):
    texts = ["at 8.8.8.8 now", "at 8.8.8.8 on 2024-05-01", "1.1.1.1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a 1 b 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = pii.pseudonymized(docs, "k")
    out = [r["text"] for r in hidden.orderBy("doc_id").collect()]
    assert out[0].split()[1] == out[1].split()[1] != "8.8.8.8" and out[2] != texts[2] and out[3] != texts[3] and out[4] == texts[4]
    assert [r["text"] for r in pii.pseudonymized(hidden, "k", undo=True).orderBy("doc_id").collect()] == texts


def test_pii_slash_dates_are_permuted_and_restored(spark):
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(0, 73048, 37)] + [datetime.date(y, 2, 29) for y in range(1904, 2097, 4)]
    texts = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = pii.pseudonymized(docs, "k")
    got = [r["text"] for r in hidden.orderBy("doc_id").collect()]
    assert len(set(got)) == len(texts) and sum(a == b for a, b in zip(got, texts, strict=True)) < 30
    assert [r["text"] for r in pii.pseudonymized(hidden, "k", undo=True).orderBy("doc_id").collect()] == texts
    for a, b in zip(got, texts, strict=True):
        assert (int(a[:2]) > 12) == (int(b[:2]) > 12) and datetime.datetime.strptime(a, "%d/%m/%Y" if int(a[:2]) > 12 else "%m/%d/%Y")


def test_feistel_is_a_permutation(spark):
    df = spark.range(17 * 13).select((F.col("id") / 13).cast("long").alias("h"), (F.col("id") % 13).alias("l"))
    p = pii.feistel(F.col("h"), F.col("l"), 17, 13, "t", "k")
    got = {(r["p"]["high"], r["p"]["low"]) for r in df.select(p.alias("p")).collect()}
    assert got == {(h, low) for h in range(17) for low in range(13)}


def test_pii_plan_is_native(spark, documents):
    plan = pii.pseudonymized(documents, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- 7 licenses ---------------------------------------------------------------------------------


def plain_licenses(words, templates=licenses.TEMPLATES):
    """Labels beside the base ones, from the definition: whole short templates, ordered words of longer ones in half overlapping windows."""
    out = {}
    for label, text in templates:
        whole = re.findall("[0-9a-z]+", text.lower())
        distinct = list(dict.fromkeys(whole))
        if len(distinct) < 10:
            if any(words[k: k + len(whole)] == whole for k in range(len(words))):
                out[label] = 1.0
            continue
        size = next(n for n in (16, 32, 64, 128) if n >= len(whole))
        for k in range(0, max(1, len(words)), size):
            best = [0] * (len(distinct) + 1)
            for w in words[k: k + 2 * size]:
                best = [0, *(max(best[j + 1], best[j] + 1) if d == w else best[j + 1] for j, d in enumerate(distinct))]
                for j in range(1, len(best)):
                    best[j] = max(best[j], best[j - 1])
            if best[-1] >= 0.8 * len(distinct) - 1e-9:
                out[label] = max(out.get(label, 0), best[-1] / len(distinct))
    return out


def test_license_scan_against_brute_force(spark, documents, odd):
    rng = np.random.default_rng(11)
    text = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of it"
    own = ["the general public license mit license MIT-License", "released under the mit", text]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        holed = " ".join(w for w in words if rng.random() > 0.12)
        mixed = " ".join(rng.permutation(words))
        # The template whole, with gaps and out of order, amidst words of other templates and of no template.
        filler = lambda n: " ".join(rng.choice(["stone", "the", "of", "license", "river", "version", "software", "in"], n))
        own += [filler(n) + " " + x + " " + filler(40) for n in (0, 7, 33) for x in (t, holed, mixed)]
    docs = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 50_000).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(70_000 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    got = licenses.license_scan(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = set()
    for r in got:
        words = [w for w in re.split(licenses.GAP, (texts[r["doc_id"]] or "").translate(low)) if w]
        places = [(k, label) for p, label in licenses.PHRASES.items() for q in [p.split()] for k in range(len(words)) if words[k: k + len(q)] == q]
        base, more = {label for _, label in places}, plain_licenses(words)
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(base)))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["labels"] == ",".join(sorted(base | set(more))), r["doc_id"]
        assert r["score"] == pytest.approx(1.0 if places else max(more.values(), default=0.0))
        seen |= set(more)
    assert seen == {label for label, _ in licenses.TEMPLATES}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_labels_by_hand(spark):
    header = dict(licenses.TEMPLATES)["apache-2.0-header"]
    line = "stone river " * 1500
    texts = {
        "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0", "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "He released it late. Under no license did the team act.": "", "Released under the MIT License.": "mit,mit-notice",
        "We are licensed under some terms.\n\nThe Apache tribe has a license.": "", "Version 2.0 of the Apache License": "apache", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0-notice",
        "This is a free program and the software can be modified.": "", "": "",
        "He was released under pressure. The MIT team lost its fishing license.": "", "Licensed dealers sold 4 cars; 0 came by train. Under BY law the CC and SA groups met.": "",
        "The GNU herd. This work, version 3, is licensed under general public review; a license.": "", line + header + line: "apache,apache-2.0-header,apache-2.0-notice", line + " ".join(reversed(header.split())) + line: "",
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0-notice",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    one = licenses.license_scan(docs, [("late", "late")]).where("labels like '%late%'").collect()
    assert [r["doc_id"] for r in one] == [2]


# --- 8 warc -------------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf):
    long = "<html>" + "x" * 2000
    rows = [(1, "http://a/\r\nX: y", long), (2, "http://b/", long), (2, "http://b/", long), (3, None, None), (None, "http://c/", long), (4, "http://d/é", "<p>é</p>"), (5, "http://e/", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in warc.archived(pages).collect())
    assert got == sorted([("1", "revisit", 2, 2006, "http://a/\r\nX: y"), ("2", "response", None, 2006, "http://b/"), ("2", "response", None, 2006, "http://b/"), ("3", "response", None, 0, ""), ("None", "response", None, 2006, "http://c/"), ("4", "response", None, 9, "http://d/é"), ("5", "response", None, 9, "http://e/")])
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_reader_refuses_what_is_broken():
    import struct

    import zstandard

    coder = zstandard.ZstdCompressor(write_checksum=True)
    good = warc.record(1, "http://a/", b"hello", None)
    data = coder.compress(good)
    assert list(warc.frames(data + warc.BETWEEN.encode("latin-1") + data)) == [good, good]
    assert warc.parsed(good)["payload"] == b"hello"
    for bad in (good[:-1], good.replace(b"hello", b"hellx"), good.replace(b"WARC/1.1", b"WURC/1.1", 1)):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    with pytest.raises(ValueError):
        list(warc.frames(data[:-6]))
    with pytest.raises(ValueError):
        list(warc.frames(struct.pack("<II", 12345, 1)))


# --- 9 packing ----------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark, documents, odd):
    from tokenizers import Tokenizer

    docs = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = packing.pack(docs, RANKS).toPandas()
    coder = Tokenizer.from_file(BPE)
    texts = docs.collect()
    ids = [e.ids + [1] for e in coder.encode_batch([r["text"] or "" for r in texts], add_special_tokens=False)]
    want = {}
    for r, x in zip(texts, ids, strict=True):
        want.setdefault(r["doc_id"], x)
    for key, part in rows.groupby("row_key"):
        part = part.sort_values("start")
        x = want[part.doc_id.iloc[0]]
        assert part.start.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(x) == part.doc_tokens.iloc[0]
        for p in part.itertuples():
            assert zlib.crc32(np.array(x[p.start: p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert rows.row_key.nunique() == len(texts)
    rows = rows.sort_values(["sequence_id", "offset"])
    sums = rows.groupby("sequence_id").length.sum()
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and sums.max() <= 2048
    assert sums.sum() / (2048 * len(sums)) > 0.95
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_cutting_stock_reaches_the_bound():
    sizes, counts = np.array([3, 5, 7, 9]), np.array([400, 300, 200, 500])
    made = packing.plan(sizes, counts, 20)
    assert sum(n * p for p, n in made).tolist() == counts.tolist() and all(p @ sizes <= 20 for p, _ in made)
    _, x = packing.solve(sizes, counts, 20)
    assert (sizes @ counts) / 20 <= x.sum() + 1e-6 and sum(n for _, n in made) <= np.ceil(x.sum()) + len(sizes)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n\t .,!1'<|endoftx>s", max_size=60))
def test_chunked_ids_are_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    coder = _coder.setdefault("x", Tokenizer.from_file(BPE))
    assert np.frombuffer(packing.encoder(RANKS).of(text), "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


_coder: dict = {}


# --- 10 chat ------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\nrole", "", "a\\n"]), st.text(alphabet="a<|im_start>end/s[INST]⁠\n", max_size=40)), max_size=6))
def test_template_is_reversible(turns):
    t = chat.Template()
    text, spans = t.format(turns)
    assert [(r, x) for r, x, _ in t.parse(text)] == turns
    assert "".join(t.unescaped(text[a:b]) for a, b in spans) == "".join(x for r, x in turns if r == "assistant")


def test_layouts_become_turns(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"}, {"system": "s", "instruction": "i", "output": None}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"messages": [{"role": "tool", "content": "x"}]}, {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), 0) for i, r in enumerate(records)] + [(9, None, 0), (8, "{bad", 0)], "conv_id long, record string, turns int")
    got = {r["conv_id"]: None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]] for r in chat.canonical_turns(df).collect()}
    assert got == {0: [("user", "p"), ("assistant", "r")], 1: [("system", "s"), ("user", "i"), ("assistant", "")], 2: [("user", "h"), ("assistant", "g")], 3: [("tool", "x")], 4: None, 8: None, 9: None}
    odd_ones = [
        ({"messages": [{"role": "human", "content": "h", "name": "n"}, {"role": "gpt", "content": "g", "weight": 1}]}, [("user", "h"), ("assistant", "g")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "image_url": {"link": "u"}}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}], "id": 7}, [("user", "ab"), ("assistant", "c")]),
        ({"prompt": "p", "response": "r", "meta": {"score": 1.5}}, [("user", "p"), ("assistant", "r")]), ({"turns": [{"speaker": "human", "text": "t"}]}, [("human", "t")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(odd_ones)], "conv_id long, record string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.canonical_turns(df).collect()}
    assert [got[i] for i in range(len(odd_ones))] == [t for _, t in odd_ones]
    assert chat.fingerprint({"a": [{"b": "x"}, {"b": None}]}) == chat.fingerprint({"a": [{"b": "y"}]})


@pytest.mark.parametrize("record, want", [
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done", "history": [["a", "b"], ["c", "d"]]}, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "do"), ("assistant", "done")]),
    ({"system": "s", "instruction": "do", "input": "", "output": "x", "history": [["a", "b"]]}, [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "do"), ("assistant", "x")]),
    ({"instruction": "do", "input": "", "output": "x", "history": [["a"]]}, None),
    ({"system": "s", "instruction": "do", "input": "it", "output": "x"}, [("system", "s"), ("user", "do\n\nit"), ("assistant", "x")]),
    ({"instruction": "i", "context": "c", "response": "r", "category": "qa"}, [("user", "i\n\nc"), ("assistant", "r")]),
    ({"system_prompt": "s", "question": "q", "response": "r", "id": "flan.1"}, [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"input": "q", "output": "r"}, [("user", "q"), ("assistant", "r")]),
    ({"prompt": "p", "response": "r", "rejected": "other"}, None),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": 3}]}, None),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": {"x": "y"}}]}, None),
    ({"messages": [{"role": "user", "content": "a"}, "b"]}, None), ({"messages": [{"role": "user", "content": "a"}, {"role": 1, "content": "a"}]}, None),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": 2}]}]}, None),
    ({"messages": [{"role": "assistant", "content": "a", "tool_calls": [{"function": {"arguments": "{}"}}]}]}, None),
    ({"messages": [{"role": "user", "content": "\ud800"}]}, None),
])
def test_no_layout_loses_text(record, want):
    known = chat.Layouts(chat.LAYOUTS)
    paths = chat.field_paths(record)
    mapping = known.of(chat.hashed(paths), paths)
    assert (mapping.read(record) if mapping else None) == want


_NAMES = st.sampled_from(["prompt", "response", "instruction", "input", "output", "history", "system", "messages", "conversations", "turns", "role", "content", "text", "from", "value", "type", "id", "x"])
_JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(_NAMES, inner, max_size=4), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(_NAMES, _JSON, max_size=5))
def test_any_record_is_read_whole_or_not_at_all(record):
    known = chat.Layouts(chat.LAYOUTS)
    paths = chat.field_paths(record)
    mapping = known.of(chat.hashed(paths), paths)
    turns = mapping.read(record) if mapping else None
    if turns is None:
        return
    held, told = [("", record)], "\n".join(t for turn in turns for t in turn)
    while held:
        name, v = held.pop()
        if name in chat.ABOUT | {"role", "from", "speaker"}:
            continue
        if isinstance(v, str):
            assert v in told or not v.strip()
        held += v.items() if isinstance(v, dict) else [(name, x) for x in v] if isinstance(v, list) else []


def test_op10_against_brute_force(spark, sf):
    got = {r["conv_id"]: r for r in queries.op10_chat_layouts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect() + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    convs = {}
    for c, t, role, text in sorted(tuple(r)[:4] for r in rows):
        convs.setdefault(c, []).append((role, text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- ids ----------------------------------------------------------------------------------------


def test_ids_are_exact(spark, sf):
    """Null ids stay null, and ids beyond 2^53 keep every bit, in all operators."""
    big = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "some text here " * (k + 3)) for k, i in enumerate(big)], "doc_id long, text string").coalesce(1)
    key = lambda i: (i is None, i)
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.select(c).distinct().collect()), key=key)
    want = sorted(big, key=key)
    assert ids(pieces.coded(docs, MODEL)) == ids(audio.texts_as_audio(docs)) == ids(packing.pack(docs, RANKS)) == ids(licenses.license_scan(docs)) == ids(pii.pseudonymized(docs, "k")) == want
    assert ids(toxicity.scored(docs, toxicity.Model())) == want
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert sorted(found, key=key) == want and set(found.values()) <= set(big)
    vectors = spark.createDataFrame([(i, [1.0, 0.5]) for i in big] + [(None, [0.0, 1.0])], "vec_id long, embedding array<float>").coalesce(1)
    got = {r["vec_id"]: r for r in crosspolytope.near_vectors(vectors.where("vec_id is not null or embedding[0] = 1")).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (3, -(2**62) - 1, i == -(2**62) - 1) for i in big}
    lone = crosspolytope.near_vectors(vectors.where("embedding[0] = 0")).first()
    assert (lone["vec_id"], lone["n_links"], lone["component_id"], lone["kept"]) == (None, 0, None, True)
    chats = spark.createDataFrame([(i, 0, "user", "x") for i in big], "conv_id long, turn long, role string, text string").coalesce(1)
    assert ids(chat.read_chats(chat.format_chats(chat.canonical_turns(chat.as_records(chats)))), "conv_id") == want
    pages = spark.createDataFrame([(i, "http://a/", "x" * 2000) for i in big if i is None or i > 0], "page_id long, url string, html string").coalesce(1)
    assert {(r["page_id"], r["refers_to"]) for r in warc.archived(pages).collect()} == {(2**60 + 1, 2**60 + 3), (2**60 + 3, None), (None, None)}


# --- the pipeline -------------------------------------------------------------------------------


def test_pipeline_runs_and_each_stage_keeps_the_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == kept and 0 < len(kept) < before
    # No two documents left are copies of each other, and what went was toxic or had a copy that stayed.
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(list(kept))).collect()]
    assert len(texts) == len(set(texts))


def test_pipeline_stages_take_an_empty_table(spark, sf, odd):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.drop("score", "component_id").limit(0), sf).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() > 0
