"""Column expressions shared by the operators: text, URLs, hashes, sets, thresholds.

Everything here is built from Spark's own functions, so it stays in the JVM and under Catalyst. Two
families need Python (NFKC and HTML entities) and are Arrow UDFs in ``newsloom.functions.python``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII letters and digits, and runs of CJK ideographs.
TOKEN = r"[a-z0-9]+|[一-鿿]+"
#: Words in retrieval: as above, ideographs in runs of two or more.
QUERY_TOKEN = r"[a-z0-9]+|[一-鿿]{2,}"
# Words that carry no meaning in retrieval and in claims.
RETRIEVAL_STOPWORDS = ["a", "an", "and", "are", "for", "from", "in", "is", "of", "on", "the", "to", "with"]
CLAIM_STOPWORDS = ["a", "an", "and", "after", "in", "is", "of", "online", "the", "to"]


def clean(c: Column) -> Column:
    """Null as empty, ends trimmed."""
    return F.trim(F.coalesce(c, F.lit("")))


def join_text(*cols: Column) -> Column:
    """The parts that are not empty, lower-cased, with single spaces between."""
    parts = F.filter(F.array(*(F.coalesce(c, F.lit("")) for c in cols)), lambda x: x != "")
    return F.lower(F.array_join(parts, " "))


def matches(pattern: str, text: Column) -> Column:
    """Case-insensitive regular expression search; character classes know Unicode."""
    return text.rlike(f"(?iuU){pattern}")


def needed_texts(pattern: str) -> list[str]:
    """The longest plain run of each alternative of a pattern, lower-cased: what matches it holds one of them. None if an alternative has no such run of ASCII or ideographs."""
    flat = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: m[0] if m[0][0] == "\\" else "\0", pattern)
    while (cut := re.sub(r"(?<!\\)\((?:\\.|[^()\\])*\)", "\0", flat)) != flat:  # groups may be left out or have alternatives of their own
        flat = cut
    found = []
    for alternative in flat.split("|"):
        plain = re.sub(r"\\\W[?*{]|\\\w|\{[^}]*\}|[^\\](?=[?*{])|(?<!\\)[.?*+^$]", "\0", alternative).replace("\\", "")
        runs = [r.lower() for r in plain.split("\0") if re.fullmatch("[\x20-\x7e一-鿿]+", r)]
        found.append(max(runs, key=lambda r: len(r.encode()), default=""))
    return found if all(found) else []


def folded(low: Column) -> Column:
    """A lower-cased text with the two letters that still equal an ASCII letter without regard to case as that letter."""
    return F.translate(low, "ſı", "si")


def found_in(pattern: str, low: Column, plain: Column) -> Column:
    """As ``matches`` for a lower-cased text, of which ``plain`` is the folded form: the pattern is tried only where a text that it needs stands in it."""
    needed = needed_texts(pattern)
    return any_contained(needed, plain) & matches(pattern, low) if needed else matches(pattern, low)


def any_contained(words: list[str], text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def count_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c, 1).otherwise(0) for c in conditions))


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in pairs)))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, no query, fragment or trailing slash; empty without scheme or host."""
    u = clean(url)
    scheme, host, path = (F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)", i) for i in (1, 2, 3))
    path = F.regexp_replace(path, "/+$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", F.lit("/")).otherwise(path)))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[^:]*://([^/]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[^:]*://[^/]*(.*)$", 1)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


_FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000"
_HALF_WIDTH = "".join(chr(0x21 + i) for i in range(94)) + " "


def half_width(text: Column) -> Column:
    """Full-width letters, digits, signs and spaces in ASCII: what NFKC does to titles, in the JVM. ``python.nfkc`` does the rest of it."""
    return F.translate(text, _FULL_WIDTH, _HALF_WIDTH)


def normalized_title(title: Column, min_length: int = 10) -> Column:
    """Token runs joined by spaces; empty if they have fewer than ``min_length`` characters. Full-width forms count as ASCII."""
    t = F.array_join(tokens(half_width(F.coalesce(title, F.lit("")))), " ")
    return F.when(F.length(F.replace(t, F.lit(" "), F.lit(""))) < min_length, F.lit("")).otherwise(t)


def query_tokens(text: Column, stopwords: list[str] = RETRIEVAL_STOPWORDS) -> Column:
    """Distinct words of two characters or more that aren't stopwords."""
    found = tokens(F.coalesce(text, F.lit("")), QUERY_TOKEN)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stopwords)))


def claim_tokens(text: Column) -> Column:
    """As ``query_tokens``, ideograph runs cut into overlapping pairs."""
    words = query_tokens(text, CLAIM_STOPWORDS)
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(words, lambda t: F.when(t.rlike("^[一-鿿]+$"), pairs(t)).otherwise(F.array(t)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two arrays taken as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller of two arrays taken as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def url_similarity(a: Column, b: Column) -> Column:
    """Of canonical URLs: 1 if equal, 0 on different hosts, else the Jaccard index of path words, 0.3 if a path has none."""
    x, y = F.array_distinct(tokens(url_path(a))), F.array_distinct(tokens(url_path(b)))
    same_host = F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.3)).otherwise(jaccard(x, y))
    return F.when((a == "") | (b == "") | (url_host(a) != url_host(b)), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(same_host)


def quote_plus(text: Column) -> Column:
    """URL encoding as of a form: letters, digits and _.-~ stay, a space becomes +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def short_hash(text: Column, prefix: str = "", n: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text.cast("binary")), 1, n))


def first_match(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for cond, value in rules:
        out = F.when(cond, lit(value)) if out is None else out.when(cond, lit(value))
    return out if otherwise is None else out.otherwise(lit(otherwise))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))
