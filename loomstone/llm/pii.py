"""Format-preserving pseudonyms for personal data, by a keyed Feistel network of column expressions.

Numbers and dates that pass their validation - card numbers (Luhn), phone numbers, social security numbers,
IPv4 addresses, calendar dates - are permuted within the set of valid values of their format, by a keyed
alternating Feistel network over two moduli. The same value gives the same pseudonym in every document and
however it is written; the permutation can be undone with the key. Mail addresses keep their domain and get
a keyed digest as their name. Nothing leaves the row: there is no shuffle.

Edge cases: a null text stays null, an empty one empty; candidates that fail validation stay as they are;
repeated rows give repeated results; an empty table gives an empty result; all other columns are kept.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Calendar days from 1900-01-01 to 2099-12-31: 17 * 4297 of them.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)

CARD = r"\d(?:[ \-]?\d){12,18}"
PHONE = r"(?:\+?1[ .\-]?)?(?:\([1-9]\d\d\) ?|[1-9]\d\d[ .\-])\d{3}[ .\-]\d{4}"
SSN = r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DATE = r"(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d"
#: A candidate begins with one of a few characters, which is tested first, and stands on its own.
NUMBERS = rf"(?=[\d+(])(?<![\p{{L}}\p{{N}}_]|\d[.\-])(?:{DATE}|{SSN}|{IPV4}|{PHONE}|{CARD})(?![\p{{L}}\p{{N}}_]|[.\-]\d)"
#: What every kind has: two adjacent digits, or a digit, a separator and a digit (1.1.1.1, 4 1 1 1).
ANY_NUMBER = r"\d[ .\-]?\d"
MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)*\.[A-Za-z]{2,24}+(?![\p{L}\p{N}])"


def keyed(value: Column, *tweaks: object, key: str) -> Column:
    """A keyed pseudo-random long of 0 to 2^60."""
    parts = [F.lit(key), *(t if isinstance(t, Column) else F.lit(str(t)) for t in tweaks), value.cast("string")]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, a: Column | int, b: Column | int, kind: str, key: str, undo: bool = False) -> Column:
    """A permutation of pairs (0 <= high < a, 0 <= low < b): each round adds a keyed function of one half to the other."""
    a, b = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    sign = -1 if undo else 1

    def turn(s: Column, r: Column) -> Column:
        to_high = F.pmod(s["high"] + sign * F.pmod(keyed(s["low"], kind, r.cast("string"), a.cast("string"), b.cast("string"), key=key), a), a)
        to_low = F.pmod(s["low"] + sign * F.pmod(keyed(s["high"], kind, r.cast("string"), a.cast("string"), b.cast("string"), key=key), b), b)
        even = r % 2 == 0
        return F.struct(F.when(even, to_high).otherwise(s["high"]).alias("high"), F.when(even, s["low"]).otherwise(to_low).alias("low"))

    rounds = list(range(ROUNDS))[:: -1 if undo else 1]
    return F.aggregate(F.array(*map(F.lit, rounds)), F.struct(high.cast("long").alias("high"), low.cast("long").alias("low")), turn)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refilled(shape: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order; all else stays."""
    return F.array_join(
        F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, F.length(digits_of(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits to which a check digit is yet to be added."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )


def _number(digits: Column, at: Column | int, n: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(digits, lit(at), lit(n)).cast("long")


def card_pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    """The first digit stays, the check digit is made anew, the digits between are permuted. Not valid: as it was."""
    d = digits_of(text)
    n = F.length(d)
    inner, half = n - 2, F.floor((n - 2) / 2).cast("int")
    rest = inner - half
    p = feistel(_number(d, 2, half), _number(d, half + 2, rest), F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), rest).cast("long"), "card", key, undo)
    body = F.concat(F.substring(d, 1, 1), F.lpad(p["high"].cast("string"), half, "0"), F.lpad(p["low"].cast("string"), rest, "0"))
    check = lambda x: F.pmod(F.lit(10) - luhn_sum(x) % 10, F.lit(10)).cast("string")
    valid = (check(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1))) & ~d.rlike(r"^(\d)\1*$")
    return F.when(valid, refilled(text, F.concat(body, check(body)))).otherwise(text)


def phone_pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    d = digits_of(text)
    ten = F.substring(d, -10, 10)
    p = feistel(_number(ten, 1, 3) - 100, _number(ten, 4, 7), 900, 10**7, "phone", key, undo)
    new = F.concat((p["high"] + 100).cast("string"), F.lpad(p["low"].cast("string"), 7, "0"))
    return refilled(text, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))


def ssn_pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    d = digits_of(text)
    area = _number(d, 1, 3)
    # 001-665 and 667-899: 898 areas; groups 01-99 and serials 0001-9999.
    p = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (_number(d, 4, 2) - 1) * 9999 + _number(d, 6, 4) - 1, 898, 99 * 9999, "ssn", key, undo)
    area = F.when(p["high"] >= 665, p["high"] + 2).otherwise(p["high"] + 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return refilled(text, F.concat(pad(area, 3), pad(F.floor(p["low"] / 9999) + 1, 2), pad(p["low"] % 9999 + 1, 4)))


def ipv4_pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    o = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", key, undo)
    return F.concat_ws(".", *(x.cast("string") for half in ("high", "low") for x in (F.floor(p[half] / 256), p[half] % 256)))


def date_pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    """Dates of 1900 to 2099; 01/02/2003 is read month first where that is a date, else day first, and each kind is permuted within itself."""
    out = F.when(text.rlike(r"^(?:1[3-9]|[23]\d)/"), day_first_pseudonym(text, key, undo)).otherwise(text)
    for like, form in ((r"^\d\d\.", "dd.MM.yyyy"), (r"^\d\d/", "MM/dd/yyyy"), (r"^\d{4}-", "yyyy-MM-dd")):
        day = F.try_to_timestamp(text, F.lit(form)).cast("date")
        index = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
        p = feistel(F.floor(index / DAYS[1]), index % DAYS[1], *DAYS, "date", key, undo)
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["high"] * DAYS[1] + p["low"]).cast("int")), form)
        out = F.when(text.rlike(like) & day.isNotNull(), new).otherwise(out)
    return out


def day_first_pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    """25/12/1999 and its like, whose day tells that it comes first: 200 years of 221 such days, and 49 days in leap years."""
    day = F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date")
    lengths = [calendar.monthrange(2001, m)[1] - 12 for m in range(1, 13)]
    before = F.array(*[F.lit(sum(lengths[:m])) for m in range(12)])
    d, m, y = F.day(day), F.month(day), F.year(day)
    plain = feistel(y - 1900, F.element_at(before, m) + d - 13, 200, sum(lengths), "day-first", key, undo)
    month = F.size(F.filter(before, lambda b: b <= plain["low"])).cast("int")
    pad = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    other = F.concat_ws("/", pad(plain["low"] - F.element_at(before, month) + 13), pad(month), (plain["high"] + 1900).cast("string"))
    turn = ((y - 1904) / 4).cast("int")
    leap = feistel(F.floor(turn / 7), turn % 7, 7, 7, "leap-day", key, undo)
    leap_day = F.concat(F.lit("29/02/"), (1904 + 4 * (7 * leap["high"] + leap["low"])).cast("string"))
    return F.when(day.isNull(), text).when((d == 29) & (m == 2), leap_day).otherwise(other)


def mail_pseudonym(text: Column, key: str) -> Column:
    name = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("mail"), F.lower(text)), 256), 1, 12)
    return F.concat(F.lit("u"), name, F.lit("@"), F.substring_index(text, "@", -1))


def replaced(text: Column, pattern: str, new) -> Column:
    """The text with new(match) for every match of the pattern; the gaps between matches are kept as they are."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.concat(g, new(m))), ""), F.element_at(gaps, -1))


def number_pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """The kind of a match decides; the kinds' patterns exclude each other in this order."""
    kind = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(kind(DATE), date_pseudonym(m, key, undo)).when(kind(SSN), ssn_pseudonym(m, key, undo)).when(kind(IPV4), ipv4_pseudonym(m, key, undo))
        .when(kind(PHONE), phone_pseudonym(m, key, undo)).otherwise(card_pseudonym(m, key, undo))
    )


def pseudonymized(docs: DataFrame, key: str, undo: bool = False, column: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced. undo: numbers and dates are restored."""
    text = F.col(column)
    if not undo:
        docs = docs.withColumn(column, F.when(F.contains(text, F.lit("@")), replaced(text, MAIL, lambda m: mail_pseudonym(m, key))).otherwise(text))
    return docs.withColumn(column, F.when(text.rlike(ANY_NUMBER), replaced(text, NUMBERS, lambda m: number_pseudonym(m, key, undo))).otherwise(text))
