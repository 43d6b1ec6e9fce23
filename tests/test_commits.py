"""Catalog and history commits, cursors, addresses, selections and exact ids."""

import ipaddress
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import audit, catalog, commits, evaluate, pages, retention, sections, vectors
from loomstone.sources.sinks import Store
from loomstone.streaming import jobs

T0 = datetime(2024, 5, 1)
OBSERVED = "document_id string, content_hash string, version_label string, published_at timestamp, etag string, last_modified string, fetched_at timestamp"


def seen(doc, h, hours):
    return (doc, h, None, None, None, None, T0 + timedelta(hours=hours))


def counts(store):
    return {(r["document_id"], r["content_hash"]): (r["is_current"], r["sections"]) for r in commits.section_counts(store).collect()}


def test_versions_sections_and_pointers_change_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    frame = lambda rows: spark.createDataFrame(rows, OBSERVED)
    parts = lambda *of: spark.createDataFrame([(d, h, i, "h", f"{h}{i}") for d, h, n in of for i in range(n)], commits.SECTION)
    gone = commits.commit(store, frame([seen("a", "h1", 1), seen("b", "h1", 1), seen("c", "h1", 1)]), parts(("a", "h1", 2), ("b", "h1", 1)), ("s", 0))
    assert [tuple(r) for r in gone.collect()] == [("c", "h1", "NO_SECTIONS")] and counts(store) == {("a", "h1"): (True, 2), ("b", "h1"): (True, 1)}
    # A replay changes nothing; an old version may come back without new sections; one that is given again has its new sections.
    assert commits.commit(store, frame([seen("a", "h9", 9)]), parts(("a", "h9", 2)), ("s", 0)) is None
    commits.commit(store, frame([seen("a", "h2", 2), seen("a", "h0", 1)]), parts(("a", "h2", 3)), ("s", 1))
    commits.commit(store, frame([seen("a", "h1", 3), seen("b", "h1", 4)]), parts(("b", "h1", 4)), ("s", 2))
    assert counts(store) == {("a", "h1"): (True, 2), ("a", "h2"): (False, 3), ("b", "h1"): (True, 4)}
    assert {(r["document_id"], r["content"]) for r in commits.current_sections(spark, store.base).collect()} == {("a", "h10"), ("a", "h11"), *(("b", f"h1{i}") for i in range(4))}


def test_version_stream_survives_a_failure_between_tables(spark, tmp_path, monkeypatch):
    base, where = str(tmp_path / "c"), str(tmp_path / "in")
    schema = OBSERVED + ", sections array<struct<ordinal: int, heading: string, content: string>>"
    row = lambda d, h, hours: (*seen(d, h, hours), [(0, "h", f"{d}{h}")])
    run = lambda: jobs.version_stream(spark.readStream.schema(schema).parquet(where), base, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([row("a", "h1", 1)], schema).coalesce(1).write.mode("append").parquet(where)
    run()
    spark.createDataFrame([row("a", "h2", 2), row("b", "h1", 2)], schema).coalesce(1).write.mode("append").parquet(where)
    whole, calls = Store._written, []

    def broken(self, name, change):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("lost between tables")
        return whole(self, name, change)

    monkeypatch.setattr(Store, "_written", broken)
    with pytest.raises(Exception, match="lost between tables"):
        run()
    store = Store(spark, base)
    assert counts(store) == {("a", "h1"): (True, 1)}
    monkeypatch.setattr(Store, "_written", whole)
    run()
    assert counts(store) == {("a", "h1"): (False, 1), ("a", "h2"): (True, 1), ("b", "h1"): (True, 1)} and store.manifest()["batches"] == {"versions": 1}


def test_kept_history_stream_equals_batch_retention(spark, tmp_path):
    schema = "request_id string, tool string, query string, request_json string, executed_at timestamp, duration_ms double"
    base, where = str(tmp_path / "h"), str(tmp_path / "in")
    rng, every = random.Random(3), []
    for batch in range(4):
        rows = [(f"r{rng.randrange(400)}", "t", f"password=x{i}", '{"token":"y"}', T0 + timedelta(hours=batch * 60 + rng.randrange(120)), 1.0) for i in range(60)]
        first = {r[0] for r in every}
        rows = list({r[0]: r for r in rows if r[0] not in first}.values())
        every += rows
        spark.createDataFrame(rows + rows[:5], schema).coalesce(1).write.mode("append").parquet(where)
        jobs.kept_history_stream(spark.readStream.schema(schema).parquet(where), base, str(tmp_path / "ck"), 4).awaitTermination()
    newest = max(r[4] for r in every)
    want = retention.within_age(spark.createDataFrame(every, schema), "executed_at", F.lit(newest), 4)
    store = Store(spark, base)
    got = store.read("history")
    assert sorted(r["request_id"] for r in got.collect()) == sorted(r["request_id"] for r in want.collect()) and 0 < got.count() < len(every)
    assert got.where("query like '%x%' or request_json like '%y%'").count() == 0 and min(store.parts("history")) >= (newest - timedelta(days=4)).strftime("%Y-%m-%d")


def test_slices_walk_the_manifest_once(spark):
    rows = [(s, d, f"s{s}", f"k{d}", "u", d % 4 != 1) for s in range(3) for d in range(5)]
    m = spark.createDataFrame(rows, "source_ord int, document_ord int, source_key string, stable_key string, url string, enabled boolean")
    mark, walked, after = catalog.manifest_fingerprint(m), [], None
    while True:
        part = catalog.execution_slice(m, after=after, limit=4, fingerprint=mark).collect()
        walked += [(r["source_key"], r["stable_key"]) for r in part]
        after = (part[-1]["next_source"], part[-1]["next_key"])
        if after[0] is None:
            break
    assert walked == [(r[2], r[3]) for r in rows if r[5]]
    assert catalog.manifest_fingerprint(m.repartition(5)) == mark
    swapped = m.withColumn("document_ord", F.when(F.col("document_ord") == 2, 3).when(F.col("document_ord") == 3, 2).otherwise(F.col("document_ord")))
    for other in (swapped, m.where("stable_key <> 'k0'")):
        with pytest.raises(ValueError, match="changed"):
            catalog.execution_slice(other, after=("s0", "k2"), limit=4, fingerprint=mark)
    with pytest.raises(ValueError, match="cursor"):
        catalog.execution_slice(m, after=("s0", "none"), limit=4)
    plan = catalog.document_plan(m, spark.createDataFrame([("s0", True), ("s1", False)], "source_key string, enabled boolean"))
    assert {(r["source_key"], r["enabled"]): (r["status"], r["reason"]) for r in plan.collect()} == {
        ("s0", True): ("planned", None), ("s0", False): ("skipped", "DISABLED"), ("s1", True): ("skipped", "DISABLED"), ("s1", False): ("skipped", "DISABLED"), ("s2", True): ("skipped", "SOURCE_NOT_FOUND"), ("s2", False): ("skipped", "SOURCE_NOT_FOUND"),
    }


def plain_public(text):
    try:
        ip = ipaddress.ip_address(text.strip().lower().strip("[]").split("%")[0])
    except ValueError:
        return False
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.version == 4:
        return not any(ip in ipaddress.ip_network(c) for c in audit.BLOCKED)
    return any(ip in ipaddress.ip_network(c) for c in audit.ALLOCATED) and ip not in ipaddress.ip_network(audit.DOCUMENTATION[0])


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(5)
    made = []
    for _ in range(150):
        n = rng.choice(audit.ALLOCATED + ["::/0", "2000::/3"])
        ip = ipaddress.IPv6Address(int(ipaddress.ip_network(n).network_address) + rng.getrandbits(100) % (1 << 104))
        made += [rng.choice([ip.compressed, ip.exploded, ip.compressed.upper(), f"[{ip.compressed}]", f"{ip.compressed}%eth0"])]
        made.append(f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}")
        made.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
    made += ["::", "::1", "2001:db8::1", "2001:dba::1", "1::2::3", "1:2:3", "2600:::1", "2600:0:0:0:0:0:0:0:1", "12345::1", "2600::1.2.3.4", "2600::1.2.3", "g::1", "", "x", ":1", "1:", "2400:1:2:3:4:5:6::", "::ffff:127.0.0.1", "::ffff:7f00:1", "8.8.8.8", "256.1.1.1", "10.0.0.1"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)] + [(9999, None)], "k int, ip string")
    want = [plain_public(m) for m in made]
    by_join = {r["k"]: r["public"] for r in audit.with_public(df).collect()}
    assert [by_join[i] for i in range(len(made))] == want and by_join[9999] is None and {True, False} == set(want)
    by_rule = {r["k"]: r["p"] for r in df.select("k", audit.public_address(F.col("ip")).alias("p")).collect()}
    assert [by_rule[i] for i in range(len(made))] == want


def test_nearest_ranks_against_sorting(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=700), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 90), "c": np.array([5.0]), "d": np.r_[np.zeros(500), 1e300, -1e300, rng.random(40) * 1e-9], None: np.arange(50.0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("e", None), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    asked = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["g"]: r for r in evaluate.nearest_ranks(df, "x", asked, "g", bins=4, small=8).collect()}
    assert len(got) == 6 and got["e"]["p50"] is None
    for g, values in groups.items():
        ordered = np.sort(values)
        assert [got[g][k] for k in asked] == [ordered[max(1, int(np.ceil(f * len(ordered)))) - 1] for f in asked.values()] and got[g]["max"] == ordered[-1]
    whole = evaluate.nearest_ranks(df.where("g = 'a'"), "x", asked, bins=4, small=8).first()
    assert whole["p50"] == got["a"]["p50"]
    assert "percentile" not in evaluate.latency_summary(df, "x", "g")._jdf.queryExecution().toString().lower()


def test_dense_search_keeps_ids_and_ties(spark):
    big = (1 << 60) + 1
    rng = np.random.default_rng(7)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (200, 4)).astype(float))] + [(big, [9.0, 9.0, 9.0, 9.0]), (None, [8.0] * 4), (300, None), (301, []), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [1.0, 1.0])]
    frame = lambda r, name: spark.createDataFrame(r, f"{name} long, embedding array<double>")
    asked = rows[:7] + [(big, [1.0] * 4), (500, [2.0, 2.0]), (501, None)]
    for sizes in ({}, {"block": 30, "query_block": 3}):
        got = vectors.dense_top_k(frame(asked, "query_id"), frame(rows, "vec_id"), 5, **sizes).collect()
        for q, x in asked:
            mine = [(r["vec_id"], r["similarity"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["position"])]
            sound = [(i, float(np.dot(x, v))) for i, v in rows if x and v and len(v) == len(x) and None not in v and not np.isnan(v).any()]
            assert mine == sorted(sound, key=lambda s: (-s[1], s[0] is not None, s[0] or 0))[:5], q
    assert vectors.dense_top_k(frame([], "query_id"), frame(rows, "vec_id"), 5).count() == 0 and vectors.dense_top_k(frame(asked, "query_id"), frame([], "vec_id"), 5).count() == 0


def test_token_drift_equals_index_drift(spark):
    texts = [("a b c", "a b c"), ("a b c", "a c b"), ("x", None), (None, "y"), ("a a", "a"), ("é", "e")]
    frame = lambda k: spark.createDataFrame([(i, t[k]) for i, t in enumerate(texts) if t[k] is not None], "section_id long, content string")
    both = [frame(0), frame(1)]
    whole = audit.index_drift(*[sections.postings(d, ["content"]) for d in both])
    short = audit.token_drift(*[sections.tokens_by_field(d, ["content"]) for d in both])
    columns = ["section_id", "side", "field", "pos", "term"]
    assert sorted(map(tuple, short.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect())) and {r["section_id"] for r in short.collect()} == {1, 2, 3, 4}


def test_page_ids_and_links(spark):
    big = (1 << 60) + 1
    html = "".join(f'<a href="https://h{i}.example.org/p">x</a>' for i in range(6))
    p = pages.extracted(spark.createDataFrame([(big, "https://a.example.org/", html), (None, "https://b.example.org/", None)], "page_id long, url string, html string"))
    assert {r["page_id"] for r in p.collect()} == {big, None}
    hosts = [("h0", "8.8.8.8"), ("h0", "10.0.0.1"), ("h1", "8.8.8.8"), ("h2", None), ("h4", "2600::1"), ("h5", "::1")]
    addresses = spark.createDataFrame([(f"{h}.example.org", ip) for h, ip in hosts], "host string, ip string")
    assert [tuple(r) for r in pages.approved_links(p, addresses, 3).orderBy("n").collect()] == [(big, 1, "https://h1.example.org/p"), (big, 2, "https://h4.example.org/p")]


@pytest.mark.parametrize("text", [
    '{"password":"hunter2"', '{"password":"hunter2"} tail', '{"a":{"password":"hunter2","b":1}} x', '{"a":' * 1200 + '{"password":"hunter2"}' + "}" * 1200, '{"apiKey": ["hunter2", "x"], "b": 1} x',
    '{"x":{"token":{"v":"hunter2"', '{"ok":1,"password" : hunter2, "b":2} x', '{"Bearer hunter2hunter2":"v"}', '{"n":1,"s":"token=hunter2"}', '{"password":"a hunter2', '[{"my secret key":{"deep":["hunter2"]}}]',
    '{"a":' * 100_000 + '{"signature":"hunter2"',
])
def test_broken_and_deep_json_keeps_no_secret(spark, text):
    out = spark.createDataFrame([(text,)], "x string").select(T.redact_json(F.col("x"))).first()[0]
    assert "hunter2" not in out and "[REDACTED]" in out
