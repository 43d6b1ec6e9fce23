"""Search: a table of queries against an index of sections.

The index is the tokens of each section, read as postings, and section lengths. Queries become phrases; each
distinct token of a section is met once with their terms, which gives the frequencies. The rarest token of each query names
(query, section) pairs, and only the sections of these are counted by place, so a frequent word is never
expanded alone. Phrase adjacency is an equi-join on positions. Scores are BM25 over the fields together; the
substring fallback runs for queries without a hit only, by the longest inner word of a query or, for one or two words, its rarest character grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.sinks import Change, Store, materialized
from .sections import expanded, postings, tokens_by_field

FIELDS = ["title", "heading", "heading_path", "content"]
#: Fixed values of the score.
K1, B = 1.2, 0.75
DEFAULT_LIMIT, MOST = 10, 50
#: Parts of a kept index: by document, and of its postings by term; characters of a gram, and grams that must stand in a row before its text is read; characters of a query that is a gram itself.
SEGMENTS, BUCKETS, GRAM, PROBES, WHOLE = 16, 16, 3, 3, 4
#: Lanes of a segment while it is written, and changed documents whose ids are broadcast.
LANES, FEW = 16, 1_000_000
#: Characters that are cut into grams at once.
CHARACTERS = 200_000


@dataclass
class Index:
    """Postings and lengths of some sections, and the sections themselves.

    A built index reads its tokens from the texts when it is asked: once for what each section holds of the queries'
    terms, and again only for the sections that are counted by place. A kept index lies in a store: sections and postings by segment (a hash of the
    document), postings within that by bucket (a hash of the term). Queries open the buckets of their terms only, and
    a change of some documents rewrites their segments only, all tables in one commit.
    """

    sections: DataFrame
    postings: DataFrame
    lengths: DataFrame
    #: Of a built index, not written: section_id, doc_id where the sections have it, fields, length.
    tokens: DataFrame | None = None

    @classmethod
    def build(cls, sections: DataFrame) -> Index:
        """sections: section_id, title, heading, heading_path, content, and any filters' columns."""
        named = [c for c in ("doc_id",) if c in sections.columns]
        made = tokens_by_field(sections, FIELDS, also=named)
        length = reduce(add, (F.size(F.col("fields")[k]["tokens"]) for k in range(len(FIELDS)))).cast("long")
        tokens = made.withColumn("length", length)
        return cls(sections, postings(sections, FIELDS), tokens.where("length > 0").select("section_id", "length"), tokens)

    def asked(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(section_id, term), the sections that hold some terms (term), once each; and the lengths of all sections."""
        if self.tokens is None:
            return materialized(self.postings.join(terms, "term", "left_semi").select("section_id", "term").distinct(), "held"), self.lengths
        # One pass over the texts, fields in a row, as positions do not matter here; the empty term stands for the section itself.
        read = self.sections.select("section_id", T.index_tokens(F.concat_ws("\n", *FIELDS)).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))
        met = read.select("section_id", "length", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("term"))
        wanted = materialized(terms.union(terms.sparkSession.range(1).select(F.lit(""))), "terms")
        held = materialized(met.join(wanted, "term", "left_semi"), "held")
        return held.where("term <> ''").select("section_id", "term"), held.where("term = '' and length > 0").select("section_id", "length")

    def within(self, sections: DataFrame) -> DataFrame:
        """The postings of some sections (section_id)."""
        # Not joined to the tokens, since Spark would tokenise every text before the join.
        of = lambda rows: rows.join(sections, "section_id", "left_semi")
        return of(self.postings) if self.tokens is None else postings(of(self.sections), FIELDS)

    def refreshed(self, changed: DataFrame, sections: DataFrame) -> Index:
        """The index after the sections of some documents were replaced; other rows are kept as they are."""
        gone = self.sections.join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select("section_id")
        new = materialized(Index.build(sections).tokens, "tokens")
        return Index(
            self.sections.join(gone, "section_id", "left_anti").unionByName(sections),
            self.postings.join(gone, "section_id", "left_anti").unionByName(expanded(new)),
            self.lengths.join(gone, "section_id", "left_anti").unionByName(new.where("length > 0").select("section_id", "length")),
        )

    def save(self, path: str, segments: int = SEGMENTS, buckets: int = BUCKETS) -> None:
        """Keep the index under path; what lay there before is replaced."""
        Store(self.sections.sparkSession, path).commit({name: Change(rows, "segment", within=within) for name, (rows, within) in self._kept(segments, buckets).items()})

    def _kept(self, segments: int, buckets: int) -> dict[str, tuple[DataFrame, list[str]]]:
        of = _segment(segments)
        if self.tokens is not None:
            # Token arrays are shuffled, a part of a segment each; postings are made behind that, where they are written.
            lane = F.pmod(F.xxhash64("section_id"), F.lit(LANES)).alias("lane")
            tokens = materialized(self.tokens, "tokens")
            spread = tokens.withColumn("segment", of).repartition("segment", lane)
            rows = expanded(spread, also=["doc_id", "segment"]).withColumn("bucket", _bucket(buckets))
            lengths = tokens.where("length > 0").select("section_id", "length", "doc_id", of)
        else:
            place = self.sections.select("section_id", "doc_id")
            rows = self.postings.join(place, "section_id").withColumns({"segment": of, "bucket": _bucket(buckets)}).repartition("segment", "bucket")
            lengths = self.lengths.join(place, "section_id").withColumn("segment", of)
        shape = self.sections.sparkSession.range(1).select(F.lit(segments).alias("segments"), F.lit(buckets).alias("buckets"), F.lit(0).alias("segment"))
        return {
            "shape": (shape, []), "sections": (self.sections.withColumn("segment", of).repartition(segments, "segment"), []), "lengths": (lengths.repartition(segments, "segment"), []),
            "postings": (rows.sortWithinPartitions("segment", "bucket", "term"), ["bucket"]),
        }

    @classmethod
    def load(cls, spark: SparkSession, path: str, terms: DataFrame | None = None) -> Index:
        """The kept index; with terms (term) its postings are pruned to their buckets."""
        store = Store(spark, path)
        postings = store.read("postings")
        if terms is not None:
            buckets = store.read("shape").first()["buckets"]
            asked = [r[0] for r in terms.select(_bucket(buckets)).distinct().collect()]  # at most the number of buckets
            postings = postings.where(F.col("bucket").isin(asked))
        return cls(store.read("sections").drop("segment"), postings.select("section_id", "field", "pos", "term"), store.read("lengths").select("section_id", "length"))

    @staticmethod
    def update(spark: SparkSession, path: str, changed: DataFrame, sections: DataFrame, batch: tuple[str, int] | None = None) -> list[int]:
        """Replace the sections of the documents in changed (doc_id) by the given ones (none: they go); returns the segments that were rewritten."""
        store = Store(spark, path)
        shape = store.read("shape").first()
        of, ids = _segment(shape["segments"]), materialized(changed.select("doc_id").unionByName(sections.select("doc_id")).distinct(), "changed")
        hit = sorted(r[0] for r in ids.select(of).distinct().collect())  # at most the number of segments
        # Some documents' ids go to every task, so that what stays is not shuffled; of many, Spark decides.
        ids = F.broadcast(ids) if ids.count() <= FEW else ids
        kept = {name: store.read(name, hit).join(ids, "doc_id", "left_anti") for name in ("sections", "lengths", "postings")}
        new = Index.build(sections)._kept(shape["segments"], shape["buckets"])
        store.commit({name: Change(rows.unionByName(new[name][0]), "segment", hit, within=new[name][1]) for name, rows in kept.items()}, batch)
        return hit


def _segment(segments: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(segments)).cast("int").alias("segment")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def tokens_of(queries: DataFrame) -> DataFrame:
    """(query_id, query) -> query_id, phrase, need, at, term: every blank-separated word is a phrase of `need` tokens, one or more."""
    words = F.filter(F.split(F.regexp_replace(F.lower(T.trimmed(F.col("query"))), '"', ""), r"\s+"), lambda w: w != "")
    phrases = queries.select("query_id", F.posexplode(F.array_distinct(words)).alias("phrase", "word"))
    tokens = phrases.select("query_id", "phrase", T.index_tokens(F.col("word")).alias("tokens"))
    return tokens.select("query_id", "phrase", F.size("tokens").alias("need"), F.posexplode("tokens").alias("at", "term"))


def rarest(tokens: DataFrame, frequency: DataFrame, by: str) -> DataFrame:
    """The tokens of each group that the fewest sections hold, one a group; frequency: term, n."""
    order = Window.partitionBy(by).orderBy(F.coalesce("n", F.lit(0)), *[c for c in ("phrase", "at") if c in tokens.columns])
    return tokens.join(frequency, "term", "left").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "n")


def matches(tokens: DataFrame, held: DataFrame, frequency: DataFrame, index: Index) -> DataFrame:
    """(query_id, section_id, phrase, tf): sections that hold every phrase of a query, with the number of places."""
    # Written, so that Spark knows their sizes: a row a query, and the sections of each query's rarest token.
    first = materialized(rarest(tokens, frequency, "query_id").select("query_id", "term"), "rarest")
    pairs = materialized(held.join(first, "term").select("query_id", "section_id"), "pairs")
    near = index.within(pairs.select("section_id")).join(tokens.select("term").distinct(), "term", "left_semi")
    # Each (query, section) asks for its tokens only, so a frequent word is met once per pair, not once per query and place.
    key = ["query_id", "section_id", "phrase"]
    counted = near.groupBy("section_id", "term").agg(F.count("*").alias("tf"))
    alone = counted.join(pairs.join(tokens.where("need = 1"), "query_id"), ["section_id", "term"]).select(*key, "tf")
    several = tokens.where("need > 1")
    met = near.join(several.select("term").distinct(), "term", "left_semi").join(pairs.join(several, "query_id"), ["section_id", "term"])
    starts = met.groupBy(*key, "need", "field", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("got")).where("got = need")
    whole = alone.unionByName(starts.groupBy(*key).agg(F.count("*").alias("tf")))
    total = tokens.where("at = 0").groupBy("query_id").agg(F.count("*").alias("phrases"))
    # A list holds at most the phrases of its query.
    found = whole.groupBy("query_id", "section_id").agg(F.collect_list(F.struct("phrase", "tf")).alias("found"))
    return found.join(total, "query_id").where(F.size("found") == F.col("phrases")).select("query_id", "section_id", F.inline("found"))


def phrase_frequency(tokens: DataFrame, frequency: DataFrame, index: Index) -> DataFrame:
    """(words, df): the sections that hold each phrase of several tokens, whatever else a query asks for."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda t: t["term"])
    several = tokens.where("need > 1")
    phrases = several.groupBy("query_id", "phrase").agg(ordered.alias("words")).select("words").distinct()
    places = materialized(index.postings.join(several.select("term").distinct(), "term", "left_semi"), "places")
    # The rarest token of a phrase names its places; its other tokens only meet those.
    first = rarest(phrases.select("words", F.posexplode("words").alias("at", "term")), frequency, "words")
    starts = places.join(first, "term").select("words", "section_id", "field", (F.col("pos") - F.col("at")).alias("start"))
    wanted = starts.select("words", "section_id", "field", "start", F.posexplode("words").alias("at", "term")).withColumn("pos", F.col("start") + F.col("at"))
    met = wanted.join(places, ["section_id", "field", "pos", "term"])
    whole = met.groupBy("words", "section_id", "field", "start").agg(F.count("*").alias("got")).where(F.col("got") == F.size("words"))
    return whole.groupBy("words").agg(F.count_distinct("section_id").alias("df"))


def bm25(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, section_id, rank): smaller is better; every phrase must occur."""
    tokens = materialized(tokens_of(queries), "asked")
    held, lengths = index.asked(tokens.select("term").distinct())
    frequency = materialized(held.groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    stats = lengths.agg(F.count("*").alias("sections"), F.avg("length").alias("mean"))
    # A phrase's document frequency counts all sections that hold it; phrases of one token are counted in the postings.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda t: t["term"])
    alone = tokens.groupBy("query_id", "phrase").agg(F.count("*").alias("k"), F.min("term").alias("term"), ordered.alias("words"))
    several = phrase_frequency(tokens, frequency, index).withColumnRenamed("df", "df2")
    df = alone.join(frequency.withColumnRenamed("n", "df1"), "term", "left").join(several, "words", "left").select("query_id", "phrase", F.when(F.col("k") == 1, F.col("df1")).otherwise(F.col("df2")).alias("df"))
    found = materialized(matches(tokens, held, frequency, index), "matches")
    scored = found.join(lengths, "section_id").join(df, ["query_id", "phrase"]).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("sections") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # Rounded, so that equal texts tie whatever the order of summing.
    return scored.groupBy("query_id", "section_id").agg(F.round(-F.sum(part), 8).alias("rank"))


def tier(query: Column) -> Column:
    """4: the whole query stands in the title, 3: in the heading, 2: in the heading path, else 1."""
    q = F.lower(T.trimmed(query))
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return F.when(has("title"), 4).when(has("heading"), 3).when(has("heading_path"), 2).otherwise(1)


def admitted(queries: DataFrame) -> Column:
    """Searchable, and within the query's source and language where it names them."""
    out = F.lit(True)
    for q, s, same in (("source_key", "source_key", False), ("language", "language", True)):
        if f"q_{q}" in queries.columns:
            a, b = F.col(f"q_{q}"), F.col(s)
            out = out & (a.isNull() | (F.lower(a) == F.lower(b) if same else a == b))
    return out


def search(queries: DataFrame, index: Index, limit: int = DEFAULT_LIMIT, fallback: bool = True) -> DataFrame:
    """(query_id, query[, q_source_key, q_language]) -> the best sections per query, with rank, score and position.

    Order: rank, score (the tier) down, title without case, ordinal, section_id. Queries of white space find nothing.
    """
    limit = max(1, min(limit, MOST))
    asked = queries.where(T.trimmed(F.col("query")) != "")
    # Matches are ranked without their contents, which only the best get, so that no text is shuffled for the others.
    hits = bm25(asked, index).join(asked, "query_id").join(index.sections.drop("content"), "section_id").where(admitted(asked))
    hits = hits.withColumn("score", tier(F.col("query")))
    order = [F.col("rank"), F.col("score").desc(), F.lower("title"), F.col("ordinal"), F.col("section_id")]
    best = hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= limit)
    best = materialized(best, "hits")  # at most limit rows a query
    rest = asked.join(best.select("query_id").distinct(), "query_id", "left_anti")
    best = best.join(index.sections.select("section_id", "content"), "section_id")
    if not fallback:
        return best
    return best.unionByName(substring_search(rest, index, limit).select(*best.columns))


def grams_of(x: Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` characters of a text, read in one pass by a pattern that looks ahead; of a shorter text none."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_code(gram: Column) -> list[Column]:
    """A gram of at most four characters as two numbers, head and tail, each of two code points; 0 stands for none."""
    at = lambda k: F.coalesce(F.nullif(F.ascii(F.substring(gram, k, 1)), F.lit(0)) + 1, F.when(F.length(gram) >= k, 1), F.lit(0)).cast("long")
    return [(F.shiftleft(at(k), 32) + at(k + 1)).alias(name) for k, name in ((1, "head"), (3, "tail"))]


def grams_by_row(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, head, tail): the distinct grams of some sizes, at most four, in any of the other columns; no gram spans two of them.

    Characters are numbered within some rows of a batch, so that a gram is one number; the sorted numbers of a row's
    longest grams begin with its shorter ones.
    """
    fields, most = [c for c in rows.columns if c != key], max(sizes)

    def cut(texts: list[list[str]]) -> tuple[np.ndarray, ...]:
        # Fields end in characters numbered 0, so grams of the longest size begin at each character and none reaches the next field.
        codes = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in row] for row in texts]
        known = np.unique(np.concatenate([c for row in codes for c in row]))
        points, end = np.concatenate([[0], known.astype(np.int64) + 1]), np.zeros(most - 1, np.uint64)
        packs, low = len(points) <= 1 << 16, np.uint64(0xFFFF)
        got = []
        for row in codes:
            c = np.concatenate([x for f in row for x in (np.searchsorted(known, f).astype(np.uint64) + np.uint64(1), end)])
            n = max(0, len(c) - most + 1)
            grams = np.zeros(n, np.uint64)
            for k in range(most if packs else 0):
                grams = grams << np.uint64(16) | c[k: k + n]
            got.append(np.unique(grams) if packs else np.unique(np.stack([c[k: k + n] for k in range(most)], 1), axis=0))
        at = np.repeat(np.arange(len(texts)), [len(g) for g in got])
        every, rows_, heads, tails = np.concatenate(got), [], [], []
        for n in sizes:
            marks = [((every >> np.uint64(16 * (most - 1 - k)) & low) if packs else every[:, k]).astype(np.int64) for k in range(n)]
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            for m in marks:
                new[1:] |= m[1:] != m[:-1]
            new &= (marks[0] > 0) & (marks[-1] > 0)
            p = [points[m[new]] for m in marks] + [np.zeros(int(new.sum()), np.int64)] * (4 - n)
            rows_.append(at[new])
            heads.append(p[0] << 32 | p[1])
            tails.append(p[2] << 32 | p[3])
        return np.concatenate(rows_), np.concatenate(heads), np.concatenate(tails)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size = [], 0
            for i in range(batch.num_rows):
                texts.append([batch.column(k + 1)[i].as_py() for k in range(len(fields))])
                size += sum(map(len, texts[-1]))
                if size > CHARACTERS or i + 1 == batch.num_rows:
                    at, head, tail = cut(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + i + 1 - len(texts))), pa.array(head), pa.array(tail)], names=[key, "head", "tail"])
                    texts, size = [], 0

    return rows.select(key, *fields).mapInArrow(read, f"`{key}` {dict(rows.dtypes)[key]}, head long, tail long")


def containing(rows: DataFrame, queries: DataFrame, fields: list[str], key: str = "section_id", probes: int = PROBES) -> DataFrame:
    """(key, query_id): rows one of whose fields holds the whole query as a substring, case aside.

    Candidates come from equi-joins, and only their texts are compared. A query of three words or more holds words
    with white space on both sides, which must then be words of the row: the longest such word is looked up. Shorter
    queries are looked up in an index of character grams: rows that have the rarest grams of the query are candidates;
    a query of at most WHOLE characters is a gram of its own length, which settles it without the text. Blank queries find nothing.
    """
    low = rows.select(key, *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    asked = queries.select("query_id", F.lower(T.trimmed(F.col("query"))).alias("_q")).where("_q <> ''").withColumn("_w", F.split("_q", r"\s+"))
    # 0: by a word, up to WHOLE: by itself, beyond: by its grams.
    asked = materialized(asked.withColumn("_k", F.when(F.size("_w") >= 3, 0).otherwise(F.least(F.length("_q"), F.lit(WHOLE + 1)))), "substrings")
    kinds = sorted(r[0] for r in asked.select("_k").distinct().collect())  # at most WHOLE + 2
    parts, checked = [], []
    if 0 in kinds or not kinds:
        inner = F.transform(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
        seeded = asked.where("_k = 0").select("query_id", "_q", F.array_max(inner)["w"].alias("seed"))
        words = F.flatten(F.array(*[F.split(f, r"\s+") for f in fields]))
        checked.append(low.select(key, F.explode(F.array_distinct(words)).alias("seed")).join(seeded, "seed").select(key, "query_id", "_q"))
    if WHOLE + 1 in kinds:
        checked.append(_gram_candidates(low, asked.where(F.col("_k") == WHOLE + 1).select("query_id", "_q"), key, probes))
    if sizes := [k for k in kinds if 0 < k <= WHOLE]:
        short = asked.where(F.col("_k").between(1, WHOLE)).select("query_id", *gram_code(F.col("_q")))
        parts.append(grams_by_row(low, key, sizes).join(short, ["head", "tail"]).select(key, "query_id"))
    if checked:
        holds = reduce(or_, (F.contains(F.col(f), F.col("_q")) for f in fields))
        parts.append(reduce(DataFrame.unionByName, checked).join(low, key).where(holds).select(key, "query_id"))
    return reduce(DataFrame.unionByName, parts)


def _gram_candidates(low: DataFrame, asked: DataFrame, key: str, probes: int) -> DataFrame:
    """(key, query_id, _q): rows that have the rarest grams of a query."""
    wanted = materialized(asked.select("query_id", "_q", F.explode(grams_of(F.col("_q"))).alias("gram")), "grams")
    named = wanted.select("gram").distinct().select("gram", *gram_code(F.col("gram")))
    found = grams_by_row(low, key, [GRAM]).join(named, ["head", "tail"]).select(key, "gram")
    found = materialized(found, "gram-postings")
    frequency = found.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "gram")
    probing = wanted.join(frequency, "gram", "left").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= probes)
    probing = materialized(probing.select("query_id", "_q", "gram", "r", F.count("*").over(Window.partitionBy("query_id")).alias("need")), "probes")
    # The rarest gram names the candidates; the next ones thin them out before any text is joined.
    first = found.join(probing.where("r = 1"), "gram").select(key, "query_id", "_q", "need")
    more = first.where("need > 1").join(probing.where("r > 1").select("query_id", "gram"), "query_id").join(found, [key, "gram"])
    thin = more.groupBy(key, "query_id", "_q", "need").agg(F.count("*").alias("got")).where("got = need - 1")
    return first.where("need = 1").select(key, "query_id", "_q").unionByName(thin.select(key, "query_id", "_q"))


def substring_search(queries: DataFrame, index: Index, limit: int) -> DataFrame:
    """The best sections any field of which holds the whole query as a substring."""
    found = containing(index.sections, queries, FIELDS).join(queries, "query_id")
    hits = found.join(index.sections, "section_id").where(admitted(queries)).withColumn("score", tier(F.col("query"))).withColumn("rank", F.lit(None).cast("double"))
    order = [F.col("score").desc(), F.lower("title"), F.col("ordinal"), F.col("section_id")]
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= limit)


def with_snippets(hits: DataFrame, radius: int = 80, terms: int = 32, each: int = 16) -> DataFrame:
    """hits (query, content) with snippet: the window of most distinct terms, then the tightest, then the first."""
    size = 2 * radius

    def best(query: str, content: str) -> str:
        import unicodedata

        import regex

        def fold(s: str) -> tuple[str, list[int] | range]:
            if s.isascii():
                return s.lower(), range(len(s))
            chars, at = [], []
            for i, c in enumerate(s):
                for x in unicodedata.normalize("NFD", c).lower():
                    if not unicodedata.combining(x):
                        chars.append(x)
                        at.append(i)
            return "".join(chars), at

        word = regex.compile(r"[\p{L}\p{N}]+")
        wanted = list(dict.fromkeys(word.findall(fold(query)[0])))[:terms]
        folded, at = fold(content)
        places: list[tuple[int, int, str]] = []
        count = dict.fromkeys(wanted, 0)
        for m in word.finditer(folded):
            if count.get(m[0], each) < each:
                count[m[0]] += 1
                places.append((at[m.start()], at[m.end() - 1] + 1, m[0]))
        start = 0
        if places:
            def weigh(begin: int) -> tuple:
                inside = [p for p in places if begin <= p[0] < begin + size]
                return (-len({p[2] for p in inside}), min(max(p[1] for p in inside), begin + size) - min(p[0] for p in inside), begin) if inside else (0, 0, begin)

            start = min(min(max(0, p[0] - radius), max(0, len(content) - size)) for p in places) if len(places) == 1 else min((weigh(min(max(0, p[0] - radius), max(0, len(content) - size))) for p in places))[2]
        raw = content[start: start + 2 * size].strip()
        body = raw if len(raw) <= size else raw[: size - 1].rstrip() + "…"
        tail = "…" if start + 2 * size < len(content) and not body.endswith("…") else ""
        return ("…" if start else "") + body + tail

    @F.pandas_udf("string")
    def snippet(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([best(q or "", c or "") for q, c in zip(query, content, strict=True)])

    return hits.withColumn("snippet", snippet("query", "content"))


def projected(hits: DataFrame, snippet_limit: int = 240) -> DataFrame:
    """Bounded output fields with fallbacks."""
    short = lambda c, n, other: T.truncate_ellipsis(F.coalesce(F.nullif(T.trimmed(F.col(c)), F.lit("")), other), n)
    return hits.select(
        "query_id", "position", "section_id", short("title", 512, F.lit("document")).alias("title"), short("heading", 256, F.col("title")).alias("heading"),
        short("source_key", 256, F.lit("catalog")).alias("source_key"), short("language", 35, F.lit("und")).alias("language"), "score", "rank",
        T.truncate_ellipsis(F.col("snippet"), snippet_limit).alias("snippet"),
    )


def with_english_fallback(queries: DataFrame, run, language: str = "q_language") -> DataFrame:
    """Queries without results in another language are run again in English, and flagged."""
    first = run(queries)
    rest = queries.join(first.select("query_id").distinct(), "query_id", "left_anti").where(~F.lower(F.coalesce(F.col(language), F.lit("en"))).startswith("en"))
    return first.withColumn("fell_back", F.lit(False)).unionByName(run(rest.withColumn(language, F.lit("en"))).withColumn("fell_back", F.lit(True)))


def result_warnings(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, policy, wanted, degraded) and (query_id, source_status, published_at, fell_back) -> warnings and status per query."""
    counted = results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_status") == "VERIFIED_OFFICIAL").alias("official"), F.count_if(F.col("published_at").isNull()).alias("undated"),
        F.bool_or("fell_back").alias("fell"),
    )
    n, official = F.coalesce("n", F.lit(0)), F.coalesce("official", F.lit(0))
    rules = {
        "NO_RESULTS": n == 0, "NO_VERIFIED_OFFICIAL_SOURCE": (n > 0) & (official == 0), "NON_OFFICIAL_RESULTS_INCLUDED": (F.col("policy") == "prefer") & (official > 0) & (official < n),
        "RESULTS_TRUNCATED": F.col("found") > F.col("wanted"), "DATE_UNAVAILABLE": F.coalesce("undated", F.lit(0)) > 0, "PARTIAL_FAILURE": F.col("degraded"), "FALLBACK": F.coalesce("fell", F.lit(False)),
    }
    warnings = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]), lambda w: w.isNotNull())
    partial = F.arrays_overlap("warnings", F.array(*map(F.lit, ("NO_RESULTS", "PARTIAL_FAILURE", "FALLBACK", "RESULTS_TRUNCATED"))))
    joined = queries.join(counted, "query_id", "left").withColumn("warnings", warnings)
    return joined.select("query_id", n.alias("n_results"), "warnings", F.when(partial, "partial").otherwise("complete").alias("status"))
