"""Stores that commit tables together, and the search index kept in one."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import search
from loomstone.sources.sinks import Change, Store

SECTION = "section_id long, doc_id long, title string, heading string, heading_path string, content string, ordinal int, source_key string, language string"


def section(i, text, doc=None):
    return (i, doc or i, "T", "", "", text, 0, "s", "en")


def test_commits_are_seen_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "k long, part int")
    assert store.commit({"a": Change(a, "part"), "b": Change(spark.range(2))}, ("stream", 0))
    assert sorted(map(tuple, store.read("a").collect())) == [(1, 0), (2, 1), (3, 1)] and store.read("b").count() == 2 and store.parts("a") == ["0", "1"]
    # A replayed batch changes nothing; a part is replaced, one goes, one is added to.
    assert not store.commit({"b": Change(spark.range(9))}, ("stream", 0)) and store.read("b").count() == 2
    store.commit({"a": Change(a.where("k = 2"), "part", [1])}, ("stream", 1))
    store.commit({"a": Change(spark.createDataFrame([(9, 1)], "k long, part int"), "part", add=True), "b": Change(parts=["all"])})
    assert sorted(map(tuple, store.read("a").collect())) == [(1, 0), (2, 1), (9, 1)] and store.read("b").count() == 0
    assert [r["k"] for r in store.read("a", [0]).collect()] == [1] and store.read("a", [7]).count() == 0
    # Earlier manifests can still be read, until their files are deleted.
    assert store.read("a", number=1).count() == 3 and store.vacuum(1) == 2
    assert sorted(map(tuple, store.read("a").collect())) == [(1, 0), (2, 1), (9, 1)] and store.numbers() == [3]


def test_a_failed_commit_leaves_the_old_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"a": Change(spark.range(3)), "b": Change(spark.range(3))})
    broken = spark.range(5).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": Change(spark.range(9)), "b": Change(broken)})
    assert store.read("a").count() == 3 and store.read("b").count() == 3
    stale = Store(spark, str(tmp_path / "s"))
    told = stale.manifest()
    store.commit({"a": Change(spark.range(1))})
    stale.manifest = lambda number=None: told
    with pytest.raises(Exception, match="(?i)exist"):
        stale.commit({"a": Change(spark.range(2))})
    assert store.read("a").count() == 1


def postings(index):
    return sorted(map(tuple, index.postings.select("section_id", "field", "pos", "term").collect()))


def test_kept_index_equals_a_rebuild(spark, tmp_path):
    path, texts = str(tmp_path / "index"), {i: f"alpha w{i} beta w{i % 3}" for i in range(1, 31)}
    built = search.Index.build(spark.createDataFrame([section(i, t) for i, t in texts.items()], SECTION))
    built.save(path, segments=8, buckets=4)
    assert postings(search.Index.load(spark, path)) == postings(built)
    before = Store(spark, path).manifest()["tables"]["postings"]["parts"]
    gone, new = spark.createDataFrame([(2,)], "doc_id long"), spark.createDataFrame([section(5, "gamma words now"), section(31, "a new one")], SECTION)
    hit = search.Index.update(spark, path, gone, new)
    texts |= {5: "gamma words now", 31: "a new one"}
    del texts[2]
    fresh = search.Index.build(spark.createDataFrame([section(i, t) for i, t in texts.items()], SECTION))
    kept = search.Index.load(spark, path)
    assert postings(kept) == postings(fresh) and sorted(map(tuple, kept.lengths.collect())) == sorted(map(tuple, fresh.lengths.collect()))
    # Segments without a changed document keep their files; a query opens the buckets of its terms.
    after = Store(spark, path).manifest()["tables"]["postings"]["parts"]
    assert 0 < len(hit) <= 3 and {p for p in before if before[p] != after.get(p)} <= set(map(str, hit))
    asked = spark.createDataFrame([("gamma",)], "term string")
    pruned = search.Index.load(spark, path, asked)
    assert len(pruned.postings.inputFiles()) >= 1 and [r["section_id"] for r in pruned.postings.where("term = 'gamma'").collect()] == [5]
    plan = pruned.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert [r["section_id"] for r in search.search(spark.createDataFrame([(1, "gamma words")], "query_id long, query string"), pruned.load(spark, path)).collect()] == [5]


def test_index_update_of_every_document_of_a_segment(spark, tmp_path):
    path = str(tmp_path / "index")
    search.Index.build(spark.createDataFrame([section(1, "one"), section(2, "two")], SECTION)).save(path, segments=2, buckets=2)
    search.Index.update(spark, path, spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([], SECTION))
    assert search.Index.load(spark, path).postings.count() == 0 and search.Index.load(spark, path).sections.count() == 0


def test_substrings_of_any_length_against_brute_force(spark):
    texts = ["Ab cd é漢字", "xyzzy ab", "", None, "a", "the end of it all", "😀😀 smile", "aaaa"]
    asked = ["a", "ab", "B C", "漢字", "é漢字", "zz", "yzzy a", "end of it", "q", "  ", "", "😀😀 s", "THE END of it all", "aaa", "aaaaa"]
    rows = spark.createDataFrame([(i, t, "K") for i, t in enumerate(texts)], "section_id long, content string, title string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = search.containing(rows, queries, ["content", "title"])
    want = {(i, q) for i, t in enumerate(texts) for q, a in enumerate(asked) if a.strip() and any(a.strip().lower() in (x or "").lower() for x in (t, "K"))}
    assert {tuple(r) for r in found.select("section_id", "query_id").collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert search.containing(rows, queries.where("false"), ["content"]).count() == 0


def test_grams_settle_short_substrings(spark):
    """Grams of one to four characters of several fields, by code points; a short query needs no text, and none is met across fields."""
    texts = [(1, "Aé\U0001f600b\0c", "xy"), (2, "", ""), (3, "z", "aé" * 40), (4, "ab ab", None)]
    rows = spark.createDataFrame(texts, "section_id long, content string, title string")
    want = {(i, g) for i, *fields in texts for t in fields if t for n in (1, 3, 4) for g in (t[k: k + n] for k in range(len(t) - n + 1))}
    asked = spark.createDataFrame([(g,) for g in sorted({g for _, g in want})], "gram string").select("gram", *search.gram_code(F.col("gram")))
    met = search.grams_by_row(rows.na.fill(""), "section_id", [1, 3, 4]).join(asked, ["head", "tail"], "left")
    assert sorted((r["section_id"], r["gram"]) for r in met.collect()) == sorted(want)
    queries = spark.createDataFrame([("é",), ("cx",), ("b ab",), ("éaéa",), ("b\0c",), ("aéaéa",), ("Ab",)], "query string").withColumn("query_id", F.col("query"))
    found = search.containing(rows, queries, ["content", "title"])
    assert sorted((r["section_id"], r["query_id"]) for r in found.collect()) == sorted([(1, "é"), (3, "é"), (4, "b ab"), (3, "éaéa"), (1, "b\0c"), (3, "aéaéa"), (4, "Ab")])


def test_a_kept_index_shuffles_token_arrays(spark):
    """Postings are made behind the shuffle; an index of no tokens of its own keeps the same."""
    index = search.Index.build(spark.createDataFrame([section(1, "b a b"), section(2, "", 7), section(3, "c", 7)], SECTION))
    rows, within = index._kept(4, 2)["postings"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("RepartitionByExpression")
    plain = search.Index(index.sections, index.postings, index.lengths)._kept(4, 2)
    for name in ("postings", "lengths"):
        kept, other = index._kept(4, 2)[name][0], plain[name][0]
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, other.select(*kept.columns).collect()))
