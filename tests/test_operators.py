import math
import os
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.operators import audit, catalog, evaluate, pages, paging, retention, search, sections, vectors, webrank
from loomstone.plans import registry as plans
from loomstone.sources import readers, sinks

T0 = datetime(2024, 5, 1)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- sections -----------------------------------------------------------------------------------

MARKDOWN = "lead\n# One ##\nbody\n```\n# not\n~~~\n````\n## Two\ntext\n### Deep é\n# Three\n"


def test_ingest_sections(spark):
    d = spark.createDataFrame([(1, "T", MARKDOWN), (2, "Plain", "no headings\nat all")], "doc_id long, title string, text string")
    got = rows_of(sections.sections(d).orderBy("doc_id", "ordinal"), "doc_id", "ordinal", "heading", "heading_path", "heading_level", "anchor")
    assert got == [(1, 0, "T", "T", 1, "document"), (1, 1, "One", "One", 1, "one"), (1, 2, "Two", "One > Two", 2, "two"), (1, 3, "Deep é", "One > Two > Deep é", 3, "deep-e"), (1, 4, "Three", "Three", 1, "three"), (2, 0, "Plain", "Plain", 1, "document")]
    body = {r["ordinal"]: r["content"] for r in sections.sections(d).where("doc_id = 1").collect()}
    assert body[0] == "lead" and body[1].startswith("# One ##\nbody\n```") and body[4] == "# Three"


def test_page_sections_of_empty_text(spark):
    d = spark.createDataFrame([(1, "T", "  \n"), (2, "T", "# A\n\n\n\n\nb")], "doc_id long, title string, text string")
    assert rows_of(sections.sections(d, "page"), "doc_id", "heading", "content") == [(2, "A", "# A\n\nb")]


def test_sections_of_many_headings_and_lines(spark):
    # More than 256 headings, in blocks, a fence between them; one heading behind 20,000 lines; one of over 256 characters.
    parts = [(f"## Part {i}", f"body {i}\n```\n# not {i}\n```" if i % 100 == 55 else f"body {i}") for i in range(1030)]
    parts += [("## Late", "x\n" * 20_000 + "x"), ("## After", "end"), ("## " + "long " * 100 + "tail", "of it")]
    text = "lead\n# Top\n" + "\n".join(f"{h}\n{b}" for h, b in parts)
    d = spark.createDataFrame([(1, "T", text)], "doc_id long, title string, text string")
    page = rows_of(sections.sections(d, "page").orderBy("ordinal"), "ordinal", "content")
    assert page == list(enumerate(["lead", "# Top", *(f"{h}\n\n{b}" for h, b in parts)]))
    got = sections.sections(d).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["content"]) for r in got] == list(enumerate(["lead", "# Top", *(f"{h}\n{b}" for h, b in parts)]))
    assert [r["heading_path"] for r in got[2:-1]] == [f"Top > {h[3:]}" for h, _ in parts[:-1]] and len(got[-1]["heading"]) <= 256
    chosen = vectors.selected(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown")), spark.createDataFrame([(1, 1, "end"), (1, 2, "1029")], "page_id long, query_id long, query string"), 1000, 3)
    assert sorted(rows_of(chosen, "query_id", "text")) == [(1, "## After\n\nend"), (2, "## Part 1029\n\nbody 1029")]


def test_heading_paths_and_fences(spark):
    text = "### Deep\n# One\n### Far\n### X\n###### Y\n## Two\n~~~~ js\n# no\n~~~\n```\n~~~~~ \n# Three\n  ```# open\n# never\n~~~"
    d = spark.createDataFrame([(1, "T", text), (2, "T", "```\n# never\n``"), (3, "T", "# a\x01b\r\n```\r\n# no\r\n```\r\n## $0")], "doc_id long, title string, text string")
    got = rows_of(sections.sections(d).orderBy("doc_id", "ordinal"), "doc_id", "heading_path")
    assert got == [*((1, p) for p in ("Deep", "One", "One > Far", "One > Far > X", "One > Far > X > Y", "One > Two", "Three")), (2, "T"), (3, "a\x01b"), (3, "a\x01b > $0")]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    d = sections.measured(spark.createDataFrame([(1, 0, "a", text), (1, 1, "b", "short"), (2, 7, "c", "short")], "doc_id long, ordinal int, anchor string, content string"))
    got = sections.chunked(d, 300, 50).orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["ordinal"], r["anchor"]) for r in got] == [(1, 0, "a"), (1, 1, "a-part-2"), (1, 2, "a-part-3"), (1, 3, "a-part-4"), (1, 4, "b"), (2, 7, "c")]
    assert got[0]["content"] + "".join(r["content"][50:] for r in got[1:4]) == text


# --- search -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, 1, "Reading files", "fs.readFile", "API > fs.readFile", "read a file with fs.readFile and a callback", 0, "node", "en"), (2, 1, "Reading files", "Streams", "API > Streams", "streams read file data in chunks file file", 1, "node", "en"),
        (3, 2, "Écrire", "Fichiers", "Fichiers", "écrire un fichier texte", 0, "node", "fr"), (4, 3, "Other", "x", "x", "nothing of interest readfilex", 0, "web", "en"),
    ]
    return search.Index.build(spark.createDataFrame(rows, "section_id long, doc_id long, title string, heading string, heading_path string, content string, ordinal int, source_key string, language string"))


def test_search_phrases_fallback_and_filters(spark, index):
    q = spark.createDataFrame([(1, "read file", None, None), (2, "fs.readFile", None, None), (3, "ecrire", None, "FR"), (4, "readfilex no", None, None), (5, "  ", None, None), (6, "file", "web", None), (7, "adfilex", None, None)], "query_id long, query string, q_source_key string, q_language string")
    got = {}
    for r in search.search(q, index).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["section_id"])
    assert set(got[1]) == {1, 2} and got[2] == [1] and got[3] == [3] and 4 not in got and 5 not in got and got[6] == [4] and got[7] == [4]


def test_phrase_frequency_counts_sections_without_the_other_words(spark):
    texts = ["well-known stone", "a well-known river", "the well-known garden", "well known-by letter", "known well stone", "stone window"] + [f"paper number{i}" for i in range(12)]
    rows = [(i, i, "", "", "", t, 0, "s", "en") for i, t in enumerate(texts)]
    built = search.Index.build(spark.createDataFrame(rows, "section_id long, doc_id long, title string, heading string, heading_path string, content string, ordinal int, source_key string, language string"))
    got = rows_of(search.bm25(spark.createDataFrame([(1, "well-known stone")], "query_id long, query string"), built), "section_id", "rank")
    lengths = [len(t.replace("-", " ").split()) for t in texts]
    n, mean = len(texts), sum(lengths) / len(texts)
    # Four sections hold the phrase (well known, adjacent), three the word.
    want = -sum(math.log((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[0] / mean)) for df in (4, 3))
    assert [r[0] for r in got] == [0] and got[0][1] == pytest.approx(want, abs=1e-6)


def test_whole_benchmark_texts_against_brute_force(spark, tmp_path):
    asked = {1: "the quick brown fox jumps over the lazy well-known dog", 2: "a river runs by the old stone garden wall", 3: "stone by stone the wall", 4: "no such words in any of them"}
    texts = ["the quick brown fox jumps over the lazy well-known dog and the cat", "the old dog jumps over a lazy brown fox quick known well", "a river runs by the old stone garden wall", "the garden wall by a river runs old stone the stone", "stone by the wall", "well-known river", *["paper letter window"] * 9]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = [f" s en | {t.replace('-', ' ')} " for t in texts]
    lengths = [len(h.replace("|", "").split()) for h in held]
    mean, want = sum(lengths) / len(texts), {}
    for q, text in asked.items():
        phrases = {f" {w.replace('-', ' ')} " for w in text.split()}
        count = lambda p, h: sum(h[i:].startswith(p) for i in range(len(h)))  # noqa: E731, B023
        df = {p: sum(p in h for h in held) for p in phrases}
        for d, h in enumerate(held):
            if all(p in h for p in phrases):
                parts = [max(math.log((len(texts) - df[p] + 0.5) / (df[p] + 0.5)), 1e-6) * (f := count(p, h)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[d] / mean)) for p in phrases]
                want[q, d] = round(-sum(parts), 5)
    got = {(r["query_id"], r["section_id"]): r["rank"] for r in plans.QUERIES["whole_text_bm25_matches"](spark, str(tmp_path)).collect()}
    assert set(want) == {(1, 0), (2, 2), (2, 3), (3, 2), (3, 3), (3, 4)} and got == pytest.approx(want, abs=2e-5)
    best = {(r["query_id"], r["position"]): r["section_id"] for r in plans.QUERIES["whole_text_document_search"](spark, str(tmp_path)).collect()}
    for q in asked:
        assert [best[k] for k in sorted(best) if k[0] == q] == sorted((d for a, d in want if a == q), key=lambda d: want[q, d])  # noqa: B023


def test_search_writes_no_row_per_place_and_no_texts(spark):
    rows = [(i, i, "", "", "", "word " * 500 + f"other{i}", 0, "s", "en") for i in range(4)]
    built = search.Index.build(spark.createDataFrame(rows, "section_id long, doc_id long, title string, heading string, heading_path string, content string, ordinal int, source_key string, language string"))
    folder = f"{sinks.shared_folder(spark)}/loomstone"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = search.search(spark.createDataFrame([(1, "word other1")], "query_id long, query string"), built, fallback=False).collect()
    written = [spark.read.parquet(f"{folder}/{name}") for name in set(os.listdir(folder)) - before]
    assert [(r["section_id"], r["content"]) for r in got] == [(1, rows[1][5])]
    # The terms asked for, and one row more a section.
    assert max(d.count() for d in written) <= 9 and not any({"content", "fields"} & set(d.columns) for d in written)


def test_one_index_serves_terms_across_fields_and_sections_without_tokens(spark):
    rows = [(1, 1, "alpha", "beta", None, "gamma gamma well-known", 0, "s", "en"), (2, 2, "alpha", "", "beta", "known well", 0, "s", "en"), (3, 3, "", "", "", "--", 0, "s", "en"), (4, 4, "", "", "", None, 0, "s", "en")]
    built = search.Index.build(spark.createDataFrame(rows, "section_id long, doc_id long, title string, heading string, heading_path string, content string, ordinal int, source_key string, language string"))
    q = spark.createDataFrame([(1, "alpha beta"), (2, "well-known gamma"), (3, "beta-gamma")], "query_id long, query string")
    plain = search.Index(built.sections, built.postings, built.lengths)
    first, second = (sorted(rows_of(search.bm25(q, index), "query_id", "section_id", "rank")) for index in (built, plain))
    assert [r[:2] for r in first] == [(1, 1), (1, 2), (2, 1)] and first == second and sorted(rows_of(built.lengths, "section_id", "length")) == [(1, 6), (2, 4)]


def test_snippets(spark):
    long = "filler " * 60 + "first needle here " + "filler " * 60 + "the needle and the thread lie close " + "filler " * 40
    h = spark.createDataFrame([(1, "needle thread", long), (2, "none", "short text"), (3, "é", "😀" * 250 + " é end")], "query_id long, query string, content string")
    got = {r["query_id"]: r["snippet"] for r in search.with_snippets(h).collect()}
    assert "needle and the thread" in got[1] and got[1].startswith("…") and got[2] == "short text" and "é" in got[3] and all(len(s) <= 163 for s in got.values())


def test_index_refresh(spark, index):
    new = index.sections.where("doc_id = 1 and ordinal = 0").withColumn("content", F.lit("brand new words"))
    fresh = index.refreshed(new.select("doc_id"), new)
    assert fresh.sections.where("doc_id = 1").count() == 1 and fresh.postings.where("term = 'brand'").count() == 1 and fresh.postings.where("term = 'chunks'").count() == 0


def test_warnings_and_english_fallback(spark):
    q = spark.createDataFrame([(1, "prefer", 10, False, 2), (2, "any", 1, True, 5), (3, "strict", 1, False, 0)], "query_id long, policy string, wanted int, degraded boolean, found int")
    r = spark.createDataFrame([(1, "VERIFIED_OFFICIAL", "2024", False), (1, "UNKNOWN", None, False), (2, "UNKNOWN", "2024", True)], "query_id long, source_status string, published_at string, fell_back boolean")
    got = {x["query_id"]: (x["warnings"], x["status"]) for x in search.result_warnings(q, r).collect()}
    assert got[1] == (["NON_OFFICIAL_RESULTS_INCLUDED", "DATE_UNAVAILABLE"], "complete") and got[3] == (["NO_RESULTS"], "partial")
    assert got[2] == (["NO_VERIFIED_OFFICIAL_SOURCE", "RESULTS_TRUNCATED", "PARTIAL_FAILURE", "FALLBACK"], "partial")
    asked = spark.createDataFrame([(1, "fr"), (2, "en"), (3, "de")], "query_id long, q_language string")
    have = spark.createDataFrame([(1, "fr"), (3, "en")], "query_id long, l string")
    run = lambda d: d.join(have, "query_id").where("q_language = l").select("query_id")
    assert sorted(rows_of(search.with_english_fallback(asked, run), "query_id", "fell_back")) == [(1, False), (3, True)]


# --- vectors ------------------------------------------------------------------------------------


def hashed(text, d=64):
    import re

    stop = {"a", "an", "and", "the", "of", "to", "in", "on", "for", "de", "la", "le", "les", "un", "une", "du", "des", "en", "au", "aux", "avec", "ou", "pour"}
    tokens = [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in stop]

    def stem(t):
        for a, b in (("ements$", "ement"), ("ations$", "ation"), ("iques$", "ique"), ("ments$", "ment"), ("eurs$", "eur"), ("ies$", "y"), ("s$", "")):
            t = re.sub(a, b, t)
        return t

    v = [0.0] * d
    for f, w in [*((t, 1) for t in tokens), *((stem(t), 0.6) for t in tokens), *((f"{a} {b}", 0.75) for a, b in zip(tokens, tokens[1:]))]:
        h = 2166136261
        for c in f:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        v[h % d] += w if h % 2 == 0 else -w
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_hashed_vectors(spark):
    texts = ["Reading the queries of stations", "", "the of", "one word words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", vectors.hashed_vector(F.col("t")).alias("v")).orderBy("i")
    for r, t in zip(df.collect(), texts, strict=True):
        assert r["v"] == pytest.approx(hashed(t))


def test_rerank_and_fusion(spark):
    rows = [(1, "node file", 1, 1, "Streams", "", "", "", "about rivers"), (1, "node file", 2, 1, "Node file", "", "", "", "node file reading"), (1, "node file", 3, 4, "Node file x", "", "", "", "z")]
    h = spark.createDataFrame(rows, "query_id long, query string, position int, score int, title string, heading string, heading_path string, snippet string, content string")
    got = vectors.reranked(h, 2).orderBy("new_position").collect()
    assert [r["position"] for r in got] == [3, 2]
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, section_id long, position int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, section_id long, position int")
    assert rows_of(vectors.fused([a, b]).orderBy("position"), "section_id") == [(11,), (10,), (12,)]
    assert vectors.overlap_at(a, b, 2).first()[0] == 0.5


def test_scores_that_differ_by_summing_alone_tie(spark):
    rows = [(1, "cat", 1, 1, "", "", "", "", "cat den men pub"), (1, "cat", 2, 1, "", "", "", "", "cat dub pen bool")]
    h = spark.createDataFrame(rows, "query_id long, query string, position int, score int, title string, heading string, heading_path string, snippet string, content string")
    got = vectors.reranked(h, 2).orderBy("new_position").collect()
    assert got[0]["combined"] < got[1]["combined"] < got[0]["combined"] + 1e-12 and [r["position"] for r in got] == [1, 2]


def test_selection_stays_within_its_budget(spark):
    p = spark.createDataFrame([(1, "# Cats\n\ncats sleep\n\n# Dogs\n\n" + "dogs run " * 40 + "\n\n# Code v1.2\n\n```\nx\n```\ncats v1.2"), (2, "")], "page_id long, markdown string")
    q = spark.createDataFrame([(1, 1, "cats"), (1, 2, "zebra"), (1, 3, ""), (2, 1, "cats")], "page_id long, query_id long, query string")
    got = {(r["page_id"], r["query_id"]): r for r in vectors.selected(p, q, 80, 5).collect()}
    first = got[1, 1]
    assert [s["heading"] for s in first["sections"]] == ["Cats", "Code v1.2"] and len(first["text"]) <= 80
    assert got[1, 2]["none_relevant"] and got[2, 1]["none_relevant"] and got[1, 3]["truncated"] and got[1, 3]["section_truncated"] and len(got[1, 3]["text"]) <= 80


# --- web ----------------------------------------------------------------------------------------


def test_web_ranking(spark):
    registry = spark.createDataFrame([(1, "n", "nodejs.org", "https://nodejs.org/", "/docs", True, ["nodejs"], ["node"], 500, True), (2, "m", "mdn.org", "https://mdn.org/", None, False, [], ["web"], 10, True)], "ordinal int, id string, domain string, base_url string, path_prefix string, include_subdomains boolean, organizations array<string>, keywords array<string>, priority int, enabled boolean")
    res = spark.createDataFrame([
        (1, "node file", 0, "Node file", "https://nodejs.org/docs/fs?utm_source=a", " s ", 5.0, ["b", "a", "b"]), (1, "node file", 1, "", "https://NODEJS.org/docs/fs/#x", "", 1.0, ["c"]), (1, "node file", 2, "Evil", "https://evilnodejs.org/docs", "", 9.0, ["a"]),
        (1, "node file", 3, "Hub", "https://github.com/nodejs/node", "", None, ["a"]), (1, "node file", 4, "Bad", "ftp://x", "", 1.0, ["a"]), (1, "node file", 5, "No docs", "https://nodejs.org/docsx", "", 1.0, ["a"]),
    ], "query_id long, query string, rank int, title string, url string, snippet string, score double, engines array<string>")
    got = webrank.ranked(webrank.mapped(res, registry), 10).orderBy("position").collect()
    by = {r["url"]: r for r in got}
    assert len(got) == 4 and got[0]["url"] == "https://nodejs.org/docs/fs" and by["https://nodejs.org/docs/fs"]["source_status"] == "VERIFIED_OFFICIAL" and by["https://nodejs.org/docs/fs"]["engines"] == ["a", "b"]
    assert by["https://github.com/nodejs/node"]["source_status"] == "VERIFIED_OFFICIAL" and by["https://nodejs.org/docsx"]["source_status"] == "UNKNOWN" and by["https://evilnodejs.org/docs"]["source_status"] == "LIKELY_OFFICIAL"
    want = 0.12 + 0.12 * 5 / 15 + 0.5 + 0.15 + 0.05 * 0.5 + 0.05 + 0.05 * 0.5
    assert got[0]["score"] == pytest.approx(min(1, want), abs=1e-6)
    q = spark.createDataFrame([(1, "how to use NODE")], "query_id long, query string")
    assert rows_of(webrank.keyword_routes(q, registry), "id") == [("n",)]


def test_own_registry_holds_every_host(spark):
    pages = spark.range(1500).select(F.format_string("https://host%04d.org/a", F.col("id")).alias("url")).union(spark.range(3).select(F.lit("https://www.example.com/").alias("url")))
    got = rows_of(plans.own_registry(pages).orderBy("ordinal"), "ordinal", "domain")
    assert got == [(k + 1, f"host{k:04d}.org") for k in range(1500)]


def test_domain_lists_and_policy(spark):
    rows = spark.createDataFrame([(1, "a.x.com", "UNKNOWN"), (1, "x.com", "VERIFIED_OFFICIAL"), (1, "y.com", "UNKNOWN"), (2, "bad.com", "UNKNOWN"), (2, "z.com", "UNKNOWN")], "query_id long, domain string, source_status string")
    allow = spark.createDataFrame([(1, "x.com")], "query_id long, domain string")
    deny = spark.createDataFrame([(1, "a.x.com"), (2, "bad.com")], "query_id long, domain string")
    assert sorted(rows_of(webrank.domain_filtered(rows, allow, deny, ["query_id", "domain"]), "query_id", "domain")) == [(1, "x.com"), (2, "z.com")]
    policy = spark.createDataFrame([(1, "strict")], "query_id long, policy string")
    assert webrank.policy_filtered(rows, policy).count() == 3


# --- pages --------------------------------------------------------------------------------------


def test_page_extraction(spark):
    html = """<html><head><title>A &amp; B</title><script>var x='<link rel="canonical" href="https://bad/">';</script><link rel=canonical href="/c?utm_source=1"></head>
    <body><!-- no --><nav>menu</nav><div class="cookie-banner">accept</div><h1>Head</h1><p>Text &#233; <a href="/l">link</a> <code>x</code></p><ul><li>one<li>two</ul><pre>a
  b</pre><script>bad()"""
    p = spark.createDataFrame([(1, "https://e.com/p", html), (2, "https://e.com/q", None)], "page_id long, url string, html string")
    r = pages.extracted(p).where("page_id = 1").first()
    assert r["title"] == "A & B" and r["canonical_url"] == "https://e.com/c" and r["links"] == ["https://e.com/l"]
    for want in ("# Head", "Text é [link](https://e.com/l) `x`", "- one", "- two", "```\na\n  b\n```"):
        assert want in r["markdown"], r["markdown"]
    for gone in ("menu", "accept", "bad", "no -->"):
        assert gone not in r["markdown"]
    assert pages.extracted(p).where("page_id = 2").first()["title"] == "e.com"


def test_character_references_end_in_a_semicolon():
    page = "<title>A &amp; B&amp</title><h1>C&amp;&amp</h1><p>&#233;&#x41;&#0;&#xD800;&copy;&quot;&Quot;&none;&am;&nbsp;x &copy"
    title, _, body, _ = pages.page_parts(page, "https://e.com/")
    assert title == "A & B&amp" and body == "# C&&amp\n\néA\ufffd\ufffd©\"\"&none;&am; x &copy"
    assert pages.attributes(' href="/q?a=1&copy=2&amp;b=3"') == {"href": "/q?a=1&copy=2&b=3"}


def test_pages_are_read_in_pieces_of_bounded_size():
    texts = ["a" * n for n in (3, 4, 0, 3, 20, 1)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.string())], names=["page_id", "html"])
    got = [p.to_pydict() for p in pages.pieces(batch, "html", 8)]
    assert [g["page_id"] for g in got] == [[0, 1, 2], [3], [4], [5, 6, 7]] and [t for g in got for t in g["html"]] == texts
    assert list(pages.pieces(batch.slice(0, 0), "html")) == []


def test_hostile_pages_are_linear():
    import time

    began = time.time()
    pages.page_parts("<div class='modal'>x" * 50_000, "https://e.com/")
    pages.page_parts("<h1>x" * 80_000, "https://e.com/")
    assert time.time() - began < 5


# --- catalog ------------------------------------------------------------------------------------


def test_outcomes_events_and_aliases(spark):
    hop = "array<struct<from_url:string,to_url:string,status:int,permanent:boolean>>"
    log = spark.createDataFrame([
        (1, "s", "new", "https://e/new", 200, None, "h1", T0, []), (1, "s", "same", "https://e/same", 200, None, "h0", T0, []), (1, "s", "n304", "https://e/n304", 304, None, None, T0, []), (1, "s", "moved", "https://e/moved2", 200, None, "h2", T0, [("https://e/moved", "https://e/moved2", 301, True)]),
        (1, "s", "gone", "https://e/gone", 410, None, None, T0, []), (1, "s", "down", "https://e/down", 503, None, None, T0, []), (1, "off", "x", "https://e/x", 200, None, "h", T0, []), (1, "none", "x", "https://e/x", 200, None, "h", T0, []),
    ], f"run_id long, source_key string, stable_key string, canonical_url string, http_status int, error_code string, content_hash string, fetched_at timestamp, redirects {hop}").withColumn("final_url", F.col("canonical_url"))
    manifest = log.select("source_key", "stable_key")
    sources = spark.createDataFrame([("s", True), ("off", False)], "source_key string, enabled boolean")
    docs = spark.createDataFrame([("s", k, i, "ACTIVE", "h0", f"https://e/{k}") for i, k in enumerate(["same", "n304", "moved", "gone", "down"])], "source_key string, stable_key string, document_id long, status string, content_hash string, canonical_url string")
    found = catalog.outcomes(manifest, log, sources, docs)
    got = {(r["source_key"], r["stable_key"]): (r["outcome"], r["new_status"]) for r in found.collect()}
    assert got["s", "new"] == ("added", "ACTIVE") and got["s", "same"][0] == got["s", "n304"][0] == "unchanged" and got["s", "moved"] == ("updated", "REDIRECTED") and got["s", "gone"] == ("updated", "REMOVED")
    assert got["s", "down"] == ("failed", "ACTIVE") and got["off", "x"][0] == "skipped:SOURCE_DISABLED" and got["none", "x"][0] == "skipped:SOURCE_NOT_FOUND"
    made = catalog.events(found)
    assert sorted(rows_of(made, "document_id", "event_type")) == [(2, "CANONICAL_CHANGED"), (2, "CONTENT_HASH_CHANGED"), (2, "PERMANENT_REDIRECT"), (3, "HTTP_410"), (4, "SOURCE_UNAVAILABLE")]
    assert catalog.valid_events(made).count() == 5
    assert rows_of(catalog.alias_rows(found).where("stable_key = 'moved'"), "url", "alias_type") == [("https://e/moved", "REDIRECT")]
    status = catalog.run_status(found).first()
    assert (status["checked"], status["added"], status["updated"], status["unchanged"], status["failed"], status["status"]) == (6, 1, 2, 2, 1, "PARTIAL")


def test_versions(spark):
    at = lambda d: T0 + timedelta(days=d)
    v = spark.createDataFrame([(1, "a", "v1", at(0), "e1", None, at(0), False), (1, "b", "v2", at(1), "e2", None, at(1), True), (2, "x", "w", at(0), None, None, at(0), True)], "document_id long, content_hash string, version_label string, published_at timestamp, etag string, last_modified string, fetched_at timestamp, is_current boolean")
    seen = spark.createDataFrame([(1, "a", at(5), None, None, "e9", None), (3, "n", at(5), None, None, None, None), (3, "m", at(4), None, None, None, None)], "document_id long, content_hash string, fetched_at timestamp, version_label string, published_at timestamp, etag string, last_modified string")
    got = {(r["document_id"], r["content_hash"]): r for r in catalog.versions_committed(v, seen).collect()}
    assert got[1, "a"]["is_current"] and not got[1, "b"]["is_current"] and got[2, "x"]["is_current"] and got[3, "n"]["is_current"] and (3, "m") not in got
    assert got[1, "a"]["version_label"] == "v1" and got[1, "a"]["published_at"] == at(0) and got[1, "a"]["etag"] == "e9"
    staged = spark.createDataFrame([(1, 10, True, False), (1, 11, False, True), (2, 20, True, False), (2, 21, False, True)], "document_id long, version_id long, is_current boolean, pending_current boolean")
    arrived = spark.createDataFrame([(11,), (11,)], "version_id long")
    now = {r["version_id"]: (r["is_current"], r["pending_current"]) for r in catalog.promoted(staged, arrived).collect()}
    assert now == {10: (False, False), 11: (True, False), 20: (True, False), 21: (False, True)}
    fresh = catalog.refreshed_validators(v, spark.createDataFrame([(1, None, "lm", at(9))], "document_id long, etag string, last_modified string, fetched_at timestamp"))
    assert rows_of(fresh.where("document_id = 1 and is_current"), "etag", "last_modified") == [("e2", "lm")]


def test_upsert_plan_slice_and_runs(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, first int, v string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, "w")], "k string, first int, v string")
    assert sorted(rows_of(catalog.upserted(old, new, ["k"], ["first"]), "k", "first", "v")) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]
    doc = "array<struct<stable_key: string, title: string, url: string, language: string, mime_type: string>>"
    m = catalog.manifest_rows(spark.createDataFrame([(1, "s", None, None, None, None, [("k1", "t", "u", None, None), ("k2", "t", "u", "en", None)]), (2, "o", "de", None, None, False, [("k3", "t", "u", None, None)])], f"ord int, source_key string, language string, source_type string, sync_strategy string, enabled boolean, documents {doc}"))
    assert sorted(rows_of(m, "stable_key", "language", "enabled")) == [("k1", "fr", True), ("k2", "en", True), ("k3", "de", False)]
    plan = {r["source_key"]: (r["planned"], r["skipped"], r["reason"]) for r in catalog.sync_plan(m, spark.createDataFrame([("s",)], "source_key string")).collect()}
    assert plan == {"s": (2, 0, None), "o": (0, 1, "DISABLED")}
    assert rows_of(catalog.execution_slice(m, after=("s", "k1"), limit=5), "stable_key") == [("k2",)]
    runs = spark.createDataFrame([(1, 1, T0, "RUNNING"), (2, 1, T0 + timedelta(1), "RUNNING"), (3, 2, T0, "RUNNING"), (4, 2, T0, "SUCCESS")], "run_id long, source_id long, started_at timestamp, status string")
    assert rows_of(catalog.overlapping_runs(runs), "run_id") == [(1,)]
    both = runs.unionByName(spark.createDataFrame([(9, None, T0, "RUNNING")], runs.schema))
    assert sorted(rows_of(catalog.overlapping_runs(both), "run_id")) == [(1,), (2,), (3,)]


# --- retention, paging --------------------------------------------------------------------------


def test_retention(spark):
    v = spark.createDataFrame([(1, i, T0 + timedelta(i), i == 5, i == 0) for i in range(6)], "document_id long, version_id long, fetched_at timestamp, is_current boolean, pending_current boolean")
    assert sorted(rows_of(retention.keep_newest_versions(v, 2), "version_id")) == [(1,), (2,)]
    runs = spark.createDataFrame([(i, T0 + timedelta(i), None, "SUCCESS" if i < 9 else "RUNNING") for i in range(10)], "run_id long, started_at timestamp, completed_at timestamp, status string")
    gone = retention.expired_runs(runs, F.lit(T0 + timedelta(8)), 3, 2)
    assert sorted(rows_of(gone, "run_id")) == [(i,) for i in range(5)]
    ev = spark.createDataFrame([(0, "x"), (8, "y")], "run_id long, e string")
    assert sorted(rows_of(retention.detached(ev, gone), "e", "run_id")) == [("x", None), ("y", 8)]
    cache = spark.createDataFrame([("k", str(i), T0 + timedelta(i), T0, 10) for i in range(30)], "kind string, cache_key string, last_accessed_at timestamp, created_at timestamp, size_bytes long")
    assert sorted(int(r[0]) for r in rows_of(retention.evicted(cache, 25, 10_000), "cache_key")) == list(range(5))
    assert sorted(int(r[0]) for r in rows_of(retention.evicted(cache, 100, 95), "cache_key")) == list(range(21))
    assert rows_of(retention.newest(cache.select(F.col("cache_key").cast("int").alias("id")), "id", 3).orderBy("id"), "id") == [(27,), (28,), (29,)]


def test_pages_of_results(spark):
    d = spark.range(45).withColumnRenamed("id", "k")
    assert rows_of(paging.offset_page(d, "k", 40, 20), "k") == [(k,) for k in range(40, 45)] and paging.next_offset(45, 40, 20) is None and paging.next_offset(45, 0, 20) == 20
    n = d.count()
    assert rows_of(paging.key_page(d, "k", 10, 3), "k", "next_before", "total") == [(9, 7, n), (8, 7, n), (7, 7, n)]
    # Page after page every row comes once, and the last page has no key to go on from.
    walked, before = [], None
    while True:
        page = paging.key_page(d, "k", before, 7).collect()
        walked += [r["k"] for r in page]
        before = page[-1]["next_before"]
        if before is None:
            break
    assert walked == sorted((r["k"] for r in d.collect()), reverse=True)
    paged = {r["k"]: (r["page"], r["next_before"]) for r in paging.key_pages(d, "k", 7).collect()}
    assert all(paged[k] == (i // 7, walked[i // 7 * 7 + 6] if (i // 7 + 1) * 7 < n else None) for i, k in enumerate(walked))
    assert {(r["page_id"], r["n"]) for r in paging.paged(d, "k").groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {(0, 20), (1, 20), (2, 5)}
    kept = paging.within_budget(d.withColumn("g", F.lit(1)), ["g"], [F.col("k")], 60)
    assert kept.agg(F.max("used")).first()[0] <= 60 and kept.count() > 2
    s = spark.createDataFrame([(1, "x" * 900)], "section_id long, content string")
    got = {r["section_id"]: (r["found"], len(r["content"]), r["truncated"]) for r in paging.read_sections(spark.createDataFrame([(1,), (2,)], "section_id long"), s, 300).collect()}
    assert got == {1: (True, 300, True), 2: (False, 0, False)}
    assert spark.range(1).select(paging.like_pattern(F.lit("50%_!"))).first()[0] == "%50!%!_!!%"


# --- audits, evaluation -------------------------------------------------------------------------


def test_integrity(spark):
    sources = spark.createDataFrame([("s", True)], "source_key string, enabled boolean")
    docs = spark.createDataFrame([(1, "s", "ACTIVE", 10), (2, "s", "ACTIVE", None), (3, "s", "ACTIVE", 99), (4, "zz", "STALE", 40)], "document_id long, source_key string, status string, current_version_id long")
    versions = spark.createDataFrame([(10, 1, True), (11, 1, True), (40, 4, False), (70, 7, False)], "version_id long, document_id long, is_current boolean")
    secs = spark.createDataFrame([(100, 10), (101, 10), (900, 999)], "section_id long, version_id long")
    indexed = spark.createDataFrame([(100,), (555,)], "section_id long")
    got = sorted(rows_of(audit.integrity_issues(sources, docs, versions, secs, indexed), "code", "key"))
    assert got == sorted([("ACTIVE_WITHOUT_VERSION", "2"), ("BAD_POINTER", "3"), ("POINTED_NOT_FLAGGED", "40"), ("FLAGGED_NOT_POINTED", "11"), ("VERSION_WITHOUT_SECTIONS", "11"), ("MISSING_IN_INDEX", "101"), ("ORPHAN_IN_INDEX", "555"), ("VERSION_WITHOUT_DOCUMENT", "70"), ("SECTION_WITHOUT_VERSION", "900"), ("DOCUMENT_WITHOUT_SOURCE", "4")])
    assert audit.report(audit.integrity_issues(sources, docs, versions, secs, indexed)).first()["status"] == "FAILED"


def test_url_safety_and_robots(spark):
    r = spark.createDataFrame([("https://a.com/", "8.8.8.8"), ("https://a.com/", "10.0.0.1"), ("https://b.com/", "8.8.8.8"), ("https://c.local/", "8.8.8.8"), ("https://d.com:8443/", "8.8.8.8"), ("ftp://e.com/", "8.8.8.8"), ("https://u@f.com/", "8.8.8.8"), ("https://g.com/", None)], "url string, ip string")
    got = dict(rows_of(audit.url_safety(r), "url", "reason"))
    assert got == {"https://a.com/": "PRIVATE_ADDRESS", "https://b.com/": None, "https://c.local/": "LOCAL_HOST", "https://d.com:8443/": "PORT", "ftp://e.com/": "SCHEME", "https://u@f.com/": "CREDENTIALS", "https://g.com/": "NO_ADDRESS"}
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: bot\n# c\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /tie\nAllow: /tie\n"
    rules_ = audit.robots_rules(spark.createDataFrame([("https://e.com", body)], "origin string, body string"), "MyBot/1.0")
    urls_ = ["https://e.com/private/x", "https://e.com/private/open/y", "https://e.com/a.pdf", "https://e.com/a.pdf?x", "https://e.com/tie", "https://e.com/", "https://other.com/private"]
    got = dict(rows_of(audit.robots_decisions(spark.createDataFrame([(u,) for u in urls_], "url string"), rules_), "url", "allowed"))
    assert [got[u] for u in urls_] == [False, True, False, True, True, True, True]


def test_quality_rules(spark):
    s = spark.createDataFrame([("ok-key", "Name", "https://e.com/", "documentation", "en"), ("Bad Key", "", "nope", "other", "??")], "source_key string, display_name string, base_url string, source_type string, language string")
    good, bad = audit.accepted_rejected(s, audit.source_errors())
    assert good.count() == 1 and len(bad.first()["errors"]) == 5
    payload = spark.createDataFrame([('{"returned":1,"results":[{"title":"t","url":"https://e.com/","score":0.5}]}',), ('{"returned":2,"results":[]}',), ("broken",)], "p string")
    assert [r[0] for r in payload.select(audit.cached_payload_valid(F.col("p"))).collect()] == [True, False, False]
    reg = spark.createDataFrame([("a", "e.com", "https://e.com/x", "/x"), ("a", "e.com", "http://e.com/", None), ("b", "e.com", "https://f.com/", "/y")], "id string, domain string, base_url string, path_prefix string")
    assert sorted(rows_of(audit.registry_errors(reg), "id", "error")) == [("a", "DUPLICATE_ID"), ("a", "NOT_HTTPS"), ("b", "OUTSIDE_DOMAIN"), ("b", "OUTSIDE_PATH")]


def test_measures(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranking = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 8, 3), (1, 9, 4), (3, 1, 1)], "query_id long, doc_id long, position int")
    qrels = spark.createDataFrame([(1, 8, 3), (1, 9, 1), (1, 5, 0), (2, 4, 1)], "query_id long, doc_id long, grade int")
    got = {r["query_id"]: r for r in evaluate.query_quality(q, ranking, qrels).collect()}
    dcg, ideal = 7 / math.log2(3) + 1 / math.log2(4), 7 + 1 / math.log2(3)
    assert (got[1]["reciprocal_rank"], got[1]["recall"], got[1]["precision"]) == (0.5, 1.0, 0.4) and got[1]["ndcg"] == pytest.approx(dcg / ideal)
    assert got[2]["zero_result"] and got[2]["recall"] == 0 and got[3]["recall"] == 1 and got[3]["ndcg"] == 1
    assert evaluate.summary(evaluate.query_quality(q, ranking, qrels)).first()["queries"] == 3
    times = spark.createDataFrame([("m", float(x)) for x in (1, 2, 3, 4, 100)], "method string, ms double")
    assert tuple(evaluate.latency_summary(times, "ms", "method").first())[1:] == (3.0, 100.0, 100.0, 100.0)
    row = spark.createDataFrame([(0.9, 0.8, 0.8, 20.0, 0.0, 1.5, 0.2, 0.0)], "recall double, mrr double, ndcg double, p95 double, gain double, latency_ratio double, paraphrase_gain double, multi_gain double")
    assert evaluate.strategy(row).first()["recommendation"] == "keep_lexical" and not evaluate.fusion_gate(row).first()["adopt"]


# --- sources and sinks --------------------------------------------------------------------------


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.md").write_text("é")
    (tmp_path / "texts" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "texts" / "c.md").write_text("x" * 100)
    good, bad = readers.text_files(spark, str(tmp_path / "texts"), 50)
    assert rows_of(good, "text") == [("é",)] and sorted(r[0] for r in rows_of(bad, "reason")) == ["NOT_UTF8", "TOO_LARGE"]
    c = spark.createDataFrame([(1, "u", "application/json", '{"a":1}'), (2, "u", "text/plain; charset=x", " t "), (3, "u", "application/pdf", "x"), (4, "https://e.com/", "text/html", "<p>hi</p>")], "page_id long, url string, content_type string, body string")
    assert dict(rows_of(readers.crawled(c), "page_id", "markdown")) == {1: '```json\n{\n  "a": 1\n}\n```', 2: "t", 4: "hi"}
    p = spark.createDataFrame([(1, "q", '{"results":[{"url":"https://e.com","engine":"g","publishedDate":"bad","language":"EN"},{"title":"t","url":"u","engines":["a"],"publishedDate":"2024-01-02"}]}')], "query_id long, query string, response string")
    got = readers.provider_results(p).orderBy("rank").collect()
    assert got[0]["engines"] == ["g"] and got[0]["title"] == "" and got[0]["published_at"] is None and got[0]["language"] == "en" and got[1]["published_at"].startswith("2024-01-02")
    base = str(tmp_path / "snap")
    for n in (3, 5):
        sinks.publish(spark.range(n), base)
        assert sinks.current(spark, base).count() == n
    paging.exported(spark.createDataFrame([(i, "x" * 9000) for i in range(3)], "k long, content string"), "k", str(tmp_path / "out"), size=2)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 3 and back.where("contentTruncated").count() == 3


def test_ranges_are_found_by_halving(spark):
    from bisect import bisect_right

    bounds = [(k // 3, str(k % 3)) for k in range(50)]
    asked = [(k, t) for k in range(-1, 18) for t in ("", "0", "1", "11", "2", "3")]
    rows = spark.createDataFrame([*asked, (None, "1"), (3, None)], "k int, t string")
    place = retention.range_of(F.struct("k", "t"), [F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in bounds])
    got = {(r["k"], r["t"]): r["p"] for r in rows.select("k", "t", place.alias("p")).collect()}
    assert got == {**{v: bisect_right(bounds, v) for v in asked}, (None, "1"): 0, (3, None): 9}
    # No row is compared with every bound.
    numbers = spark.range(1000).withColumn("id", F.col("id") * 7 % 1000)
    out = retention.running(numbers, ["id"], F.col("id"), partitions=40)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["rank"], r["before"]) for r in out.collect()) == [(i, i + 1, i * (i - 1) // 2) for i in range(1000)]


def test_drift_reads_its_sides_once(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "section_id long, content string")
    a, b = rows((1, "x y x"), (2, "same"), (3, "gone"), (5, "p"), (5, "p")), rows((1, "x z x"), (2, "same"), (4, "new"), (5, "p"))
    held = [sections.tokens_by_field(d, ["content"]) for d in (a, b)]
    want = sorted([(1, "stored", 1, "y"), (1, "fresh", 1, "z"), (3, "stored", 0, "gone"), (4, "fresh", 0, "new"), (5, "stored", 0, "p")])
    found = audit.index_drift(*(sections.expanded(d) for d in held))
    drift = audit.token_drift(*held)
    # Whole sections have one row a key; postings may repeat.
    for got, rest in ((found, want), (drift, [w for w in want if w[0] != 5])):
        assert sorted(map(tuple, got.select("section_id", "side", "pos", "term").collect())) == rest
    assert "regexp" not in drift._jdf.queryExecution().optimizedPlan().toString()
