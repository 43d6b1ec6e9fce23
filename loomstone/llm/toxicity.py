"""Toxicity by noisy-channel deobfuscation: restore what was written over, then score the restored text.

Words written in leetspeak, spaced out or with letters repeated are character lattices: every observed
character may stand for some letters, a run for one letter or two, a separator for nothing, one mask or two in a row within a
word for as many letters of any kind or none. Three masks in a row and more are read as separators, since so many unknown letters
fit too many words; words cut by separators are joined again up to 24 letters. Viterbi decoding
under a trigram character model picks the likeliest letters. The character model counts all documents, mixed
with the words of the learned lexicon. Words of plain letters have one path and are left as they are.

The score of a text is a noisy-or over the lexicon's words and word beginnings found in the restored text.
A lexicon entry is one that labelled rows bear out: its share of toxic texts is beyond chance for the number
of entries tried, counting near copies of a text once.

Edge cases: a null or empty text scores the base; labels that are null are not learned from; repeated rows
count once in the fit and get equal scores; without toxic labels every text scores the base; a null doc_id
teaches nothing and stays null; an empty table gives an empty result; other columns are kept, and a score or
predicted column that was there is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a fit takes at most (those of the smallest hash of doc_id).
FIT_ROWS = 20_000
#: Fixed values of the channel: the letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
#: Fixed values of the channel: what may stand for any letter within a word.
MASKS = "*#?%"
#: Costs of the channel, as logarithms: a substitution, a dropped repeat, a kept repeat of a long run, a dropped symbol, a symbol kept, a word boundary in spaced letters, a masked letter, a mask that stands for none.
SUBSTITUTED, DROPPED, KEPT, SKIPPED, LITERAL, BOUNDARY, MASKED, UNMASKED = -0.7, -1.5, -1.5, -2.5, -12.0, -1.0, -1.0, -6.0
BASE, PRIOR_WEIGHT, CHANCE = 0.02, 1.0, 1.0
PREFIXES = (4, 5, 6)
LETTERS, SIDE = "abcdefghijklmnopqrstuvwxyz", 27
#: Tokens whose outcome a worker keeps, characters counted and features sent on at once: at most, but for one text.
CACHE, CHARACTERS, FEATURES = 200_000, 200_000, 20_000


def folded(text: str) -> str:
    """Letters without their accents, compatibility forms as plain ones."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _code_table() -> np.ndarray:
    out = np.zeros(0x251, np.int16)
    for c in range(0x250):
        base = folded(chr(c).lower())[:1] or " "
        base = {"ß": "s", "ø": "o", "æ": "a", "đ": "d", "ł": "l"}.get(base, base)
        out[c] = LETTERS.find(base) + 1
    return out


CODES = _code_table()
RUNS, REPEATS, SHAPE = re.compile(r"(.)\1*", re.S), re.compile(r"(.)\1+", re.S), re.compile(r"(.)\1\1", re.S)
#: Letters of another script that look like Latin ones, beside Latin ones; and a mask between letters.
MIXED = re.compile(rf"(?=.*[a-z]).*[{''.join(c for c in LEET if c.isalpha() and not c.isascii())}]", re.S)
MASKED_WORD = re.compile(rf"[^\W\d_][{re.escape(MASKS)}]+[^\W\d_]")
#: Ornaments around a word: three or more of one symbol, and punctuation.
ORNAMENT = re.compile(r"^(?:([^\w\s])\1\1+)+|(?:([^\w\s])\2\2+)+$")
LEAD, TAIL = re.compile(r"^[^\w@$!|+(€£¡]+"), re.compile(r"[^\w@$+]+$")
BETWEEN = re.compile(r"[\W_]+")
#: What most words end in; TAIL strips it, too.
ENDS = ".,;:!?)\"'"
#: Three or more tokens of up to three characters, in a string of a mark per token.
SHORT = re.compile(rb"\x01{3,}")
#: What parts a long token, symbols that may stand for letters aside.
APART = re.compile(r"(?:[^\w@$!|+(€£¡]|_)+")
#: Characters decoded at once, and those that two such pieces of a longer run share.
LONGEST, SHARED = 64, 24


def squeezed(word: str) -> str:
    return REPEATS.sub(r"\1", folded(word))


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of (letter before last, last letter, letter), boundaries included, of many texts."""
    x = CODES[np.minimum(np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32), 0x250)].astype(np.int32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    word = (b > 0) | (c > 0)
    a, b, c = a[word], b[word], c[word]
    return np.bincount(np.where(b > 0, a, 0) * SIDE * SIDE + b * SIDE + c, minlength=SIDE**3)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents; each task sums its own, at most 27^3 numbers reach the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIDE**3, np.int64)
        for batch in batches:
            held, size = [], 0
            for t in batch["text"]:
                if t:
                    held.append(t.lower())
                    size += len(t)
                if size > CHARACTERS:
                    total += trigrams(held)
                    held, size = [], 0
            total += trigrams(held)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    out = np.zeros(SIDE**3, np.int64)
    for r in docs.select("text").mapInPandas(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    n = counts.reshape(SIDE, SIDE, SIDE) + 0.02
    return np.log(n / n.sum(axis=2, keepdims=True))


@dataclass
class Model:
    """What scores a text: the character model and the lexicon. Small enough to go out with the tasks."""

    logp: list = field(default_factory=lambda: log_probabilities(np.zeros(SIDE**3)).tolist())
    lexicon: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.whole = {k[2:] for k in self.lexicon if k[0] == "w"}
        self.keys = {squeezed(k[2:]) for k in self.lexicon if k[0] == "w"}
        self.beginnings = {k[2:] for k in self.lexicon if k[0] == "p"}
        self.seen: dict[str, tuple[str, ...]] = {}
        self.read: dict[str, list[str]] = {}

    def __getstate__(self) -> dict:
        return {"logp": self.logp, "lexicon": self.lexicon}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    # --- restoring -----------------------------------------------------------------------------

    def decode(self, observed: str, spaced: bool = False) -> str:
        """The likeliest letters behind a word; blanks where spaced letters hold several words."""
        code = {c: k + 1 for k, c in enumerate(LETTERS)}
        paths = {(0, 0): (0.0, "")}
        for m in RUNS.finditer(observed):
            c, n = m[1], len(m[0])
            plain = folded(c)[:1]
            options: list[tuple[str, float]] = []
            masked = c in MASKS and n < 3 and 0 < m.start() and m.end() < len(observed)
            if masked:
                options = [(x, MASKED * n) for x in LETTERS] if n == 1 else [(x + y, MASKED * n) for x in LETTERS for y in LETTERS]
            reads = [(plain, 0.0)] if plain in code else [(x, SUBSTITUTED) for x in LEET.get(c, "")]
            for x, cost in reads:
                if n == 1:
                    options.append((x, cost))
                else:
                    options += [(x, cost + (DROPPED if n == 2 else 0.0)), (x + x, cost + (0.0 if n == 2 else KEPT))]
            if plain not in code:
                options += [("", UNMASKED if masked else SKIPPED)] if not c.isalnum() else [(c, LITERAL)]
            if spaced:
                options += [(" " + x, cost + BOUNDARY) for x, cost in options if x]
            following: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in paths.items():
                for out, cost in options:
                    p, q, total = a, b, score + cost
                    for x in out:
                        k = code.get(x, 0)
                        if k or q:
                            total += self.logp[p][q][k]
                        p, q = (q, k) if k else (0, 0)
                    if total > following.get((p, q), (-math.inf,))[0]:
                        following[p, q] = (total, text + out)
            paths = following
        if not paths:
            return observed
        return max((s + (self.logp[a][b][0] if b else 0.0), t) for (a, b), (s, t) in paths.items())[1].strip()

    def words(self, token: str) -> list[str]:
        """The restored words of one blank-free token."""
        core = token.rstrip(ENDS)
        if not core.isalpha():
            core = TAIL.sub("", LEAD.sub("", ORNAMENT.sub("", token)))
        if core.isalpha():
            if core.isascii() and not REPEATS.search(core) or self.known(core):
                return [core]
            if not core.isascii() and MIXED.match(core) or SHAPE.search(core) or (REPEATS.search(core) or not core.isascii()) and squeezed(core) in self.keys:
                return [self.decode(core)]
            return [core]
        if not any(c.isalpha() for c in core):
            return []
        if len(core) > LONGEST:
            return self.long_words(core)
        parts = [p for p in BETWEEN.split(core) if p]
        if len(parts) > 2 and all(len(p) == 1 for p in parts):
            return [*self.decode("".join(parts), spaced=True).split(), *(self.behind_masks(core) if MASKED_WORD.search(core) else [])]
        if parts == [core] or any(c in LEET and not c.isalnum() for c in core[:-1]) or MASKED_WORD.search(core):
            out = self.decode(core)
            if out.isalpha():
                return [out, *(self.behind_masks(core) if MASKED_WORD.search(core) else [])]
        out = [w for p in parts for w in ([p] if p.isalpha() else [self.decode(p)])]
        return out + self.across(out)

    def behind_masks(self, core: str) -> list[str]:
        """The lexicon's words that are paths of a masked word's lattice; at least half of their letters must show."""
        shown = sum(c not in MASKS for c in core)
        lattice = "".join(
            f"[a-z]{{1,{len(m[0])}}}" if m[1] in MASKS else f"[{folded(m[1])[:1] if folded(m[1])[:1] in LETTERS else LEET.get(m[1], '') or '-'}]{{1,{len(m[0])}}}"
            for m in RUNS.finditer(core)
        )
        return [k[2:] for k in self.lexicon if k[0] == "w" and 3 < len(k) - 2 <= 2 * shown and re.fullmatch(lattice, k[2:])]

    def known(self, word: str) -> bool:
        """In the lexicon as it stands."""
        return word in self.whole or not self.beginnings.isdisjoint([word[:n] for n in PREFIXES if len(word) > n])

    def long_words(self, core: str) -> list[str]:
        """The words of a long token: part by part, three or more one-letter parts as spaced letters."""
        out: list[str] = []
        run: list[str] = []
        for p in [*APART.split(core), "", "..."]:
            if not p:
                continue
            if len(p) == 1 and (p.isalpha() or p in LEET):
                run.append(p)
                continue
            out += self.run_words(run) if len(run) > 2 else [c for c in run if c.isalpha()]
            run = []
            if p.isalpha():
                out.append(p)
            elif p != "...":
                for at in range(0, max(1, len(p) - SHARED), LONGEST - SHARED):
                    out += self.words(p[at: at + LONGEST])
        return out + self.across(out)

    def run_words(self, run: list[str]) -> list[str]:
        """Words behind spaced letters, decoded in pieces; the lexicon's words are looked for at every place."""
        out: list[str] = []
        for at in range(0, max(1, len(run) - SHARED), LONGEST - SHARED):
            words = self.decode("".join(run[at: at + LONGEST]), spaced=True).split()
            joined = "".join(words)
            out += [*words, *(k[2:] for k in self.lexicon if k[0] == "w" and len(k) > 5 and k[2:] in joined)]
        return out

    def across(self, words: list[str]) -> list[str]:
        """The lexicon's words that separators cut: neighbours that make one together."""
        out = []
        for i, text in enumerate(words[:-1]):
            for other in words[i + 1:]:
                text += other
                if len(text) > SHARED:
                    break
                if len(text) > 3 and f"w:{text}" in self.lexicon:
                    out.append(text)
        return out

    def spaced_words(self, tokens: list[str]) -> Iterator[str]:
        """Words behind runs of three or more one-letter tokens."""
        run: list[str] = []
        places = SHORT.finditer(bytes([len(t) < 4 for t in tokens]))
        for t in [t for m in places for t in [*tokens[m.start(): m.end()], "..."]]:
            letter = t if len(t) == 1 else TAIL.sub("", t[:3]) if len(t) < 4 else ""
            if len(letter) == 1 and (letter.isalpha() or letter in LEET):
                run.append(letter)
                continue
            if len(run) > 2:
                words = self.decode("".join(run), spaced=True).split()
                yield from words
                # Where a word begins among spaced letters is uncertain: the lexicon's words are looked for at every place.
                joined = "".join(words)
                yield from (k[2:] for k in self.lexicon if k[0] == "w" and len(k) > 5 and k[2:] in joined)
            run = []

    def restored(self, text: str) -> list[str]:
        tokens = unicodedata.normalize("NFKC", text).lower().split() if not text.isascii() else text.lower().split()
        read, out = self.read, []
        if len(read) > CACHE:
            read.clear()
        for t in tokens:
            got = read.get(t)
            if got is None:
                got = self.words(t)
                if len(t) < 40:
                    read[t] = got
            out += got
        return [*out, *self.spaced_words(tokens)]

    # --- scoring -------------------------------------------------------------------------------

    def found(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in features(word) if f in self.lexicon) if self.known(word) else ()

    def score(self, text: str | None) -> float:
        if not text or not self.lexicon:
            return BASE
        tokens = unicodedata.normalize("NFKC", text).lower().split() if not text.isascii() else text.lower().split()
        seen, hits = self.seen, set()
        if len(seen) > CACHE:
            seen.clear()
        for t in set(tokens):
            got = seen.get(t)
            if got is None:
                got = tuple(f for w in self.words(t) for f in self.found(w))
                if len(t) < 40:
                    seen[t] = got
            if got:
                hits.update(got)
        for w in self.spaced_words(tokens):
            hits.update(self.found(w))
        miss = 1.0 - BASE
        for f in sorted(hits):
            miss *= 1.0 - self.lexicon[f]
        return 1.0 - miss


def features(word: str) -> list[str]:
    """The word, and its beginnings that are shorter than it."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]


# --- learning -----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def upper_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of k or more of n, by the Chernoff bound."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from documents and their toxic labels; held-out rows teach nothing."""
    counts = character_counts(docs)
    model = Model(log_probabilities(counts).tolist())
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taught = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # at most FIT_ROWS small rows

    def marked(text: str | None) -> tuple[set[str], int]:
        """The words of a text, and a mark that its near copies share, most likely: the least hash of word triples."""
        read = model.restored(text or "")
        return set(read), min(xxhash.xxh64_intdigest(" ".join(read[i: i + 3])) for i in range(max(1, len(read) - 2))) >> 1

    def toxic_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words, mark = marked(text)
                out += [(f, mark) for f in {f for w in words for f in features(w)}]
                if len(out) > FEATURES:
                    yield pd.DataFrame(out, columns=["feature", "mark"])
                    out = []
            yield pd.DataFrame(out, columns=["feature", "mark"])

    toxic = taught.where("toxic = 1").mapInPandas(toxic_features, "feature string, mark long").distinct().groupBy("feature").agg(F.count("*").alias("n")).where("n >= 3")
    # Of the bounded sample's toxic rows alone. From here on a feature goes by its number; -1 stands for the text.
    wanted = {r["feature"]: k for k, r in enumerate(toxic.orderBy("feature").collect())}

    def wanted_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[str, list[int]] = {}
        for batch in batches:
            out, held = [], 0
            for toxic, text in zip(batch["toxic"].tolist(), batch["text"], strict=True):
                words, mark = marked(text)
                got = {-1}
                if len(numbers) > CACHE:
                    numbers.clear()
                for w in words:
                    of = numbers.get(w)
                    if of is None:
                        of = numbers[w] = [wanted[f] for f in features(w) if f in wanted]
                    got.update(of)
                out.append((toxic, mark, np.fromiter(got, np.int32, len(got))))
                held += len(got)
                if held > FEATURES:
                    yield pd.DataFrame(out, columns=["toxic", "mark", "features"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["toxic", "mark", "features"])

    rows_of = taught.mapInPandas(wanted_features, "toxic int, mark long, features array<int>")
    both = rows_of.select("toxic", "mark", F.explode("features").alias("k")).distinct().groupBy("k").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    names = ["", *wanted]  # in the order of their numbers, from -1
    counted = {names[r["k"] + 1]: (r["n"], r["t"]) for r in both.collect()}
    total, bad = counted.pop("", (0, 0))
    if not total or not bad or bad == total:
        return model
    share, level = bad / total, math.log(CHANCE / max(1, len(counted)))
    lexicon = {}
    for f, (n, t) in counted.items():
        p = (t + PRIOR_WEIGHT * share) / (n + PRIOR_WEIGHT)
        if p > (0.5 if f[0] == "w" else 0.8) and upper_tail(t, n, share) < level:
            lexicon[f] = min(p, 0.98)
    # The lexicon's words count as much as all documents in the character model.
    words = [w[2:] for w in lexicon if w[0] == "w"]
    if words:
        own = trigrams([" ".join(words)]).astype(float)
        by_pair = counts.reshape(SIDE * SIDE, SIDE).sum(axis=1, keepdims=True)
        scale = np.maximum(by_pair, 1) / np.maximum(own.reshape(SIDE * SIDE, SIDE).sum(axis=1, keepdims=True), 1)
        counts = counts + (own.reshape(SIDE * SIDE, SIDE) * scale).ravel()
    return Model(log_probabilities(counts).tolist(), lexicon)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (score >= threshold)."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [*batch.columns, pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(scores, schema)
