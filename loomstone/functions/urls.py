"""URL and host expressions. What is not a safe http(s) URL is null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = ["dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "_hsenc", "_hsmi"]
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
LABEL = r"[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?"
IPV4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def host(url: Column) -> Column:
    """Lower case, without port and closing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r":\d*$", ""), r"\.$", "")


def port(url: Column) -> Column:
    written = F.regexp_extract(authority(url), r":(\d+)$", 1)
    return F.when(written != "", written.cast("int")).when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def domain_name(x: Column) -> Column:
    """A host name in lower case without closing dot, or an address as it is; null where it is neither."""
    name = F.regexp_replace(F.lower(F.trim(x)), r"\.$", "")
    sound = (F.length(name) <= 253) & name.rlike(rf"^{LABEL}(?:\.{LABEL})*$")
    return F.when(sound | name.rlike(rf"^{IPV4}$") | name.rlike(r"^\[[0-9a-f:.]+\]$"), name)


def domain_matches(name: Column, domain: Column) -> Column:
    """Equal, or a subdomain; addresses only when equal."""
    return (name == domain) | (~name.rlike(rf"^{IPV4}$") & F.endswith(name, F.concat(F.lit("."), domain)))


def host_suffixes(name: Column) -> Column:
    """The name and its parents, so that suffix joins are equi-joins."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _sound(url: Column) -> Column:
    return (F.length(url) <= 4096) & scheme(url).isin("http", "https") & ~F.contains(authority(url), F.lit("@")) & domain_name(host(url)).isNotNull()


def _assembled(url: Column, at: Column, ask: Column) -> Column:
    shown = F.when(port(url) == F.when(scheme(url) == "https", 443).otherwise(80), "").otherwise(F.concat(F.lit(":"), port(url).cast("string")))
    return F.when(_sound(url), F.concat(scheme(url), F.lit("://"), host(url), shown, at, F.when(ask == "", "").otherwise(F.concat(F.lit("?"), ask))))


def transport_url(x: Column) -> Column:
    """Checked, without fragment and default port; the query as it was."""
    url = F.trim(x)
    return _assembled(url, F.when(path(url) == "", "/").otherwise(path(url)), query(url))


def canonical_url(x: Column) -> Column:
    """One form for all spellings: no tracking keys, query keys in order, no closing slashes."""
    url = F.trim(x)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(TRACKING))
    pairs = F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    ordered = F.array_join(F.transform(F.array_sort(pairs), lambda s: s["p"]), "&")
    bare = F.regexp_replace(path(url), r"/+$", "")
    return _assembled(url, F.when(bare == "", "/").otherwise(bare), ordered)


def ipv4_number(x: Column) -> Column:
    parts = F.split(x, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    return F.when(x.rlike(rf"^{IPV4}$"), value)


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def address_words(x: Column) -> Column:
    """struct<hi: bigint, lo: bigint>: an address as 128 bits; IPv4 as its form within IPv6 (::ffff:a.b.c.d); null where it is neither.

    Any spelling of IPv6 is read: short forms, upper case, a dotted end, a zone, brackets.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^\[|\]$", ""), r"%.*$", "")

    def in_groups(t: Column) -> Column:
        """A dotted end as two groups."""
        dotted = F.regexp_extract(t, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        hexed = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return let(dotted, lambda d: F.when(d == "", t).otherwise(F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(d)), let(ipv4_number(d), hexed))))

    def eight(halves: Column) -> Column:
        """The groups, with those that :: stands for."""
        side = lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":"))
        filled = lambda a: let(side(F.get(halves, F.lit(1))), lambda b: F.when(F.size(a) + F.size(b) <= 7, F.concat(a, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(a) - F.size(b))), b)))
        return let(side(F.get(halves, F.lit(0))), lambda a: F.when(F.size(halves) == 1, a).when(F.size(halves) == 2, filled(a)))

    word = lambda g, a: F.aggregate(F.slice(g, a, 4), F.lit(0).cast("long"), lambda h, p: F.shiftleft(h, 16).bitwiseOR(F.conv(p, 16, 10).cast("long")))
    sound = lambda g: (F.size(g) == 8) & F.forall(g, lambda p: p.rlike("^[0-9a-f]{1,4}$"))
    words = lambda t: let(eight(F.split(in_groups(t), "::")), lambda g: F.when(sound(g), F.struct(word(g, 1).alias("hi"), word(g, 5).alias("lo"))))
    four = lambda n: F.struct(F.lit(0).cast("long").alias("hi"), n.bitwiseOR(F.lit(0xFFFF << 32)).alias("lo"))
    return let(text, lambda t: F.when(F.contains(t, F.lit(":")), words(t)).otherwise(let(ipv4_number(t), lambda n: F.when(n.isNotNull(), four(n)))))
