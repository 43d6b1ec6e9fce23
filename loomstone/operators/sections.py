"""Texts to headings, sections, chunks and postings, one distributed pass over the texts each.

What depends on the order of lines, code fences and the headings above a heading, stays inside the row of a text.
Everything is expressions, so it runs in whole-stage code or beside it, and grows with the text, however many lines
and headings it has: a fold that gathers headings would copy all it has for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Bounds of headings and paths as labels.
HEADING, PATH = 256, 1024
CHUNK, OVERLAP = 12_000, 400
ATX = r"^ {0,3}(#{1,6})[\t ]+(.+?)\s*$"
#: A fence from its opening to its closing line, or to the end of the text.
FENCE = r"(?dm)^ {0,3}(?:(`{3,}+)[\s\S]*?(?:\n {0,3}\1`*+[\t ]*+$|\z)|(~{3,}+)[\s\S]*?(?:\n {0,3}\2~*+[\t ]*+$|\z))"


def lines_of(x: Column) -> Column:
    return F.split(F.regexp_replace(x, r"\r\n", "\n"), "\n")


def headings(x: Column, lines: Column) -> Column:
    """array<struct<line, level, whole, title>> of all ATX headings outside fences of a text, lines its column of lines; title is cut as a label, whole is not."""
    # Fences stand between marks, so every other piece is one; no line in them starts with # then.
    pieces = F.split(F.regexp_replace(F.replace(F.regexp_replace(x, r"\r\n", "\n"), F.lit("\x01"), F.lit("\x02")), FENCE, "\x01$0\x01"), "\x01")
    bare = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("#"), F.lit(" "))).otherwise(p)), "")
    seen = F.when(x.contains("```") | x.contains("~~~"), F.split(bare, "\n")).otherwise(lines)
    at = F.filter(F.transform(seen, lambda line, i: F.when(line.rlike(ATX), i)), lambda i: i.isNotNull())
    whole = lambda line: T.trimmed(F.regexp_replace(F.regexp_extract(line, ATX, 2), r"[\t ]+#+[\t ]*$", ""))
    found = F.transform(at, lambda i: F.struct(i.alias("line"), F.length(F.regexp_extract(lines[i], ATX, 1)).alias("level"), whole(lines[i]).alias("whole")))
    return F.transform(F.filter(found, lambda h: h["whole"] != ""), lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["whole"].alias("whole"), T.truncate_ellipsis(h["whole"], HEADING).alias("title")))


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds paths to rows of heads: for each heading the titles of those it lies under, and its own."""
    heads, n = F.col("heads"), F.size("heads")
    # A heading is at most one deeper than the one before; six levels, so the five before it tell.
    depth = lambda h, i: F.least(i + 1, h["level"], *[F.when(i >= k, heads[i - k]["level"] + k) for k in range(1, 6)])
    marked = rows.withColumn("marks", F.transform(heads, lambda h, i: F.struct(i.alias("i"), depth(h, i).alias("depth"), h["title"].alias("title"))))

    def above(deep: int) -> Column:
        """For each heading the title of the last one of that depth."""
        own = F.filter("marks", lambda m: m["depth"] == deep)
        runs = F.zip_with(own, F.slice(own, 2, n), lambda a, b: F.array_repeat(a["title"], F.coalesce(b["i"], n) - a["i"]))
        return F.concat(F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.try_element_at(own, F.lit(1))["i"], n)), F.flatten(runs))

    paths = F.transform("marks", lambda m: F.struct(m["depth"].alias("depth"), m["title"].alias("path")))
    paths = reduce(lambda a, deep: F.zip_with(a, above(deep), lambda m, t: F.struct(m["depth"].alias("depth"), F.when(m["depth"] > deep, F.concat(t, F.lit(" > "), m["path"])).otherwise(m["path"]).alias("path"))), range(5, 0, -1), paths)
    return marked.withColumn("paths", F.transform(paths, lambda m: T.truncate_ellipsis(m["path"], PATH))).drop("marks")


def sections(docs: DataFrame, mode: str = "ingest") -> DataFrame:
    """(doc_id, title, text) -> a row per section: ordinal, heading, heading_path, level, anchor, content and its measures.

    ingest: the heading line is part of the content, a text without headings is one section under its title.
    page: the text is normalised, a section is heading, empty line, body; an empty text has no sections; flat.
    All lines and headings of a text count; a heading's label is cut, its content is not.
    """
    text = T.normal_markdown(F.col("text")) if mode == "page" else F.col("text")
    read = docs.select("doc_id", "title", text.alias("text")).withColumn("lines", lines_of(F.col("text")))
    read = read.withColumn("heads", headings(F.col("text"), F.col("lines")))
    read = read if mode == "page" else with_paths(read)
    body = lambda a, b: T.trimmed(F.array_join(F.slice(F.col("lines"), a, b), "\n"))
    following = lambda i: F.coalesce(F.try_element_at(F.col("heads"), i + 2)["line"], F.size("lines"))
    first = F.when(F.size("heads") > 0, F.col("heads")[0]["line"])
    if mode == "page":
        made = F.transform("heads", lambda h, i: F.struct(h["title"].alias("heading"), h["title"].alias("path"), F.lit(1).alias("level"), F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["whole"]), F.nullif(body(h["line"] + 2, following(i) - h["line"] - 1), F.lit(""))).alias("content")))
        lead_heading, alone = F.lit(""), F.col("text")
    else:
        made = F.transform("heads", lambda h, i: F.struct(h["title"].alias("heading"), F.col("paths")[i].alias("path"), h["level"].alias("level"), body(h["line"] + 1, following(i) - h["line"]).alias("content")))
        lead_heading, alone = F.col("title"), F.col("text")
    lead = F.struct(lead_heading.alias("heading"), lead_heading.alias("path"), F.lit(1).alias("level"), F.when(first.isNull(), alone).otherwise(body(F.lit(1), first)).alias("content"))
    wanted = F.filter(F.concat(F.array(lead), made), lambda s: (s["content"] != "") | (F.lit(mode == "ingest") & first.isNull()) | (s["heading"] != lead_heading))
    out = read.select("doc_id", "title", F.posexplode(wanted).alias("ordinal", "s")).select("doc_id", "title", "ordinal", "s.*")
    anchor = F.when((F.col("ordinal") == 0) & (F.col("heading") == F.col("title")), "document").otherwise(T.slug(F.col("heading")))
    return measured(out.select("doc_id", "title", "ordinal", "heading", F.col("path").alias("heading_path"), F.col("level").alias("heading_level"), anchor.alias("anchor"), "content"))


def measured(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"content_hash": T.sha256(F.col("content")), "character_count": F.length("content"), "token_count": T.token_count(F.col("content"))})


def chunked(rows: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Sections of over so many characters become overlapping windows; then all ordinals of that document count anew."""
    n, step = F.length("content"), size - overlap
    parts = F.when(n <= size, F.array(F.struct(F.lit(0).alias("part"), F.col("content").alias("content")))).otherwise(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")), lambda k: F.struct(k.alias("part"), T.trimmed(F.substring(F.col("content"), k * step + 1, F.lit(size))).alias("content"))),
            lambda p: p["content"] != "",
        )
    )
    by_doc = Window.partitionBy("doc_id")
    split = rows.withColumn("any_long", F.max((n > size).cast("int")).over(by_doc)).withColumn("p", F.explode(parts))
    again = F.row_number().over(by_doc.orderBy("ordinal", "p.part")) - 1
    out = split.withColumn("new_ordinal", F.when(F.col("any_long") == 1, again).otherwise(F.col("ordinal")))
    anchor = F.when(F.col("p.part") > 0, F.concat("anchor", F.lit("-part-"), (F.col("p.part") + 1).cast("string"))).otherwise(F.col("anchor"))
    kept = [c for c in rows.columns if c not in ("ordinal", "anchor", "content", "content_hash", "character_count", "token_count")]
    return measured(out.select(*kept, F.col("new_ordinal").alias("ordinal"), anchor.alias("anchor"), F.col("p.content").alias("content")))


def useful(text: Column) -> Column:
    """Eight words or more: what a plain read gave is enough."""
    return T.token_count(text) >= 8


def tokens_by_field(rows: DataFrame, fields: list[str], key: str = "section_id", also: list[str] = []) -> DataFrame:
    """(key, other columns, fields: the tokens of each of some text columns)."""
    return rows.select(key, *also, F.array(*[F.struct(F.lit(f).alias("field"), T.index_tokens(F.coalesce(F.col(f), F.lit(""))).alias("tokens")) for f in fields]).alias("fields"))


def expanded(held: DataFrame, key: str = "section_id", also: list[str] = []) -> DataFrame:
    """(key, other columns, field, pos, term) of what tokens_by_field holds."""
    return held.select(key, *also, F.explode("fields").alias("f")).select(key, *also, "f.field", F.posexplode("f.tokens").alias("pos", "term"))


def postings(rows: DataFrame, fields: list[str], key: str = "section_id") -> DataFrame:
    """(key, field, pos, term) of every token of some text columns."""
    # Fields become rows before they are tokenised, so that Spark does it once a text, and not in one method too long to compile.
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields])
    return rows.select(key, F.explode(texts).alias("f")).select(key, "f.field", F.posexplode(T.index_tokens(F.col("f.text"))).alias("pos", "term"))
