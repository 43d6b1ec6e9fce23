"""Text expressions: folding, tokens, hashes, truncation, redaction."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def _accents() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters that decompose into one base letter, and those bases."""
    pairs = []
    for c in [*map(chr, range(0xC0, 0x250)), *map(chr, range(0x386, 0x460)), *map(chr, range(0x1E00, 0x1F00))]:
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Combining marks; translate() drops what has no counterpart.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold_accents(x: Column) -> Column:
    """Letters without combining marks. translate() is slow, so texts of plain ASCII skip it."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, ACCENTED + MARKS, PLAIN)).otherwise(x)


def truncate_ellipsis(x: Column, most: int) -> Column:
    """At most so many code points; a cut text ends in an ellipsis."""
    return F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most - 1), r"\s+$", ""), F.lit(ELLIPSIS))).otherwise(x)


def cut_at_boundary(x: Column, most: Column | int) -> Column:
    """Cut at the last blank or line end, where it lies in the last three tenths of what is allowed."""
    most = most if isinstance(most, Column) else F.lit(most)
    head = F.substring(x, F.lit(1), most - 1)
    last = F.greatest(F.length(head) - F.length(F.substring_index(head, " ", -1)), F.length(head) - F.length(F.substring_index(head, "\n", -1))) - 1
    end = F.when(last >= F.floor(most * 0.7), last).otherwise(F.length(head)).cast("int")
    cut = F.concat(F.regexp_replace(F.substring(head, F.lit(1), end), r"\s+$", ""), F.lit(ELLIPSIS))
    return F.when(most <= 0, "").when(most == 1, ELLIPSIS).when(F.length(x) > most, cut).otherwise(x)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normal_markdown(x: Column) -> Column:
    """Line ends as \\n, at most two empty lines in a row, no blanks around."""
    return trimmed(F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"\n{4,}", "\n\n\n"))


def slug(x: Column, default: str = "section") -> Column:
    plain = F.regexp_replace(F.lower(fold_accents(x)), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"^-+|-+$", ""), F.lit("")), F.lit(default))


def token_count(x: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(x, F.lit(r"\S+"))


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 4).cast("long")


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def public_id(source: Column, stable: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws(":", source, stable), 256), 1, 24))


def stable_key(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    return F.when(path == "", "index").otherwise(path)


def request_fingerprint(query: Column, allow: Column, deny: Column, *parts: Column) -> Column:
    """The same for any order of domains and any case of the query."""
    return F.sha2(F.to_json(F.struct(F.lower(query).alias("query"), F.array_sort(allow).alias("allow"), F.array_sort(deny).alias("deny"), *parts)), 256)


def language_tag(x: Column) -> Column:
    """language-Script-REGION; null where it is not a tag of at most 35 characters."""
    t = F.trim(x)
    parts = F.split(t, "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(p.rlike("^[A-Za-z]{4}$"), F.initcap(p)).when(p.rlike("^[A-Za-z]{2}$"), F.upper(p)).otherwise(F.lower(p)))
    sound = t.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$") & (F.length(t) <= 35)
    return F.when(sound, F.array_join(cased, "-"))


#: Character references by name.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ocirc": "ô", "ugrave": "ù", "euro": "€", "deg": "°",
}
REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);"


def _code_point(n: Column) -> Column:
    """A code point as text: its UTF-8 bytes; what is no character becomes U+FFFD."""
    b = lambda k: F.lpad(F.hex(k), 2, "0")
    tail = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(63)) + 128
    code = (
        F.when(n < 0x80, b(n)).when(n < 0x800, F.concat(b(F.shiftright(n, 6) + 192), b(tail(0))))
        .when(n < 0x10000, F.concat(b(F.shiftright(n, 12) + 224), b(tail(6)), b(tail(0)))).otherwise(F.concat(b(F.shiftright(n, 18) + 240), b(tail(12)), b(tail(6)), b(tail(0))))
    )
    bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(bad, "�").otherwise(F.decode(F.unhex(code), "UTF-8"))


def decode_references(x: Column) -> Column:
    """Decimal, hexadecimal and named character references; unknown names stay."""
    names = F.create_map(*[F.lit(v) for pair in NAMED.items() for v in pair])

    def one(m: Column) -> Column:
        body = F.substring(m, F.lit(2), F.length(m) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 10), 16, 10)).otherwise(F.substring(body, 2, 10)).cast("int")
        return F.when(body.startswith("#"), _code_point(number)).otherwise(F.coalesce(F.try_element_at(names, body), m))

    gaps, found = F.split(x, REFERENCE, -1), F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0))
    done = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.concat(g, one(m))), ""), F.element_at(gaps, -1))
    return F.when(F.contains(x, F.lit("&")), done).otherwise(x)


def clean_snippet(x: Column) -> Column:
    """References decoded, tags dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(decode_references(x), r"<[^>]*>", " "), r"\s+", " "))


#: What a secret looks like.
SECRETS = [
    (r"(?i)Bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16})\b", "[REDACTED]"),
    (r"(?i)(\b(?:authorization|credential|password|passwd|secret|token|access[-_]?token|refresh[-_]?token|api[-_]?key|signature|sig)\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s&,;]+)", "$1[REDACTED]"),
]
SENSITIVE_KEY = r"(?i)api.?key|authorization|credential|password|passwd|secret|token|signature|sig"


def redact(x: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), SECRETS, x)


def redact_map(m: Column) -> Column:
    """A map of strings: values of sensitive keys go, other values are redacted as texts."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(redact(v)))


def redact_json(x: Column) -> Column:
    """A JSON text with its secrets gone, at any depth and within arrays.

    The value of a sensitive key goes, whatever its type; other strings are redacted as texts, and so are keys; numbers,
    booleans and nulls stay as they are. A text that is no JSON (cut off, followed by something else, nested deeper than the parser
    goes) is redacted as a text, and what follows a quoted sensitive key goes by pattern: a whole string, a scalar, or all
    that is left of the text where an object or array begins, since its end cannot be told. SQL has no walk over a value of unknown depth, so this
    runs in Arrow batches.
    """

    @F.pandas_udf("string")
    def walked(texts: pd.Series) -> pd.Series:
        # Java's classes are ASCII unless told otherwise, and so are these.
        rules = [(re.compile(p, re.ASCII), r.replace("$1", r"\1")) for p, r in SECRETS]
        sensitive = re.compile(SENSITIVE_KEY)

        def plain(s: str) -> str:
            for p, r in rules:
                s = p.sub(r, s)
            return s

        # A quoted key that holds a sensitive word, its colon, and the value: a string (whole or cut off), the rest from a bracket on, or a scalar.
        keyed = re.compile(rf'("(?:[^"\\]|\\.)*?(?:{SENSITIVE_KEY[4:]})(?:[^"\\]|\\.)*"\s*:\s*)("(?:[^"\\]|\\.)*"?|[\[{{].*|[^\s,\]}}]+)', re.I | re.S)

        def broken(s: str) -> str:
            return plain(keyed.sub(r'\1"[REDACTED]"', s))

        def walked_value(top: object) -> object:
            out: list = [top]
            held = [(out, 0)]  # containers and the places in them that are still to be looked at
            while held:
                into, at = held.pop()
                v = into[at]
                if isinstance(v, str):
                    into[at] = plain(v)
                elif isinstance(v, list):
                    into[at] = list(v)
                    held += [(into[at], k) for k in range(len(v))]
                elif isinstance(v, dict):
                    # A key that is a secret itself goes, too; equal ones are told apart by their number.
                    into[at] = new = {}
                    for k, i in v.items():
                        name, n = plain(k), 1
                        while name in new:
                            n += 1
                            name = f"{plain(k)} {n}"
                        new[name] = "[REDACTED]" if sensitive.search(k) else i
                        if not sensitive.search(k):
                            held.append((new, name))
            return out[0]

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return json.dumps(walked_value(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return broken(t)

        return texts.map(one)

    return walked(x)


#: Words that carry no meaning in a hashed vector.
STOP_WORDS = ["a", "an", "and", "au", "aux", "avec", "de", "des", "du", "en", "for", "in", "la", "le", "les", "of", "on", "ou", "pour", "the", "to", "un", "une"]


def content_tokens(x: Column, most: int) -> Column:
    """Letters, digits and dots, two characters or more, the first so many of them."""
    found = F.regexp_extract_all(fold_accents(F.lower(x)), F.lit(r"[\p{L}\p{N}.]+"), F.lit(0))
    return F.slice(F.filter(found, lambda t: F.length(t) >= 2), 1, most)


def distinct_terms(x: Column) -> Column:
    found = F.regexp_extract_all(fold_accents(F.lower(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def index_tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold_accents(F.lower(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def feature_tokens(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(fold_accents(x)), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


#: Suffix rewrites, applied in this order.
SUFFIXES = [("ements$", "ement"), ("ations$", "ation"), ("iques$", "ique"), ("ments$", "ment"), ("eurs$", "eur"), ("ies$", "y"), ("s$", "")]


def stem(x: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), SUFFIXES, x)


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over code units, as a long."""
    units = F.filter(F.split(x, ""), lambda c: c != "")
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
