"""Personal data in whole texts, disguised identifiers included, as spans of the source text.

Four kinds: email, ip, card, phone. Plain patterns find the base spans. Offset-preserving
deobfuscation adds others: a chain of transducers rewrites a text and carries, for each character it
gives out, the source characters that it stands for, so a match in the rewritten text maps back to
the source. The transducers, in order: homoglyphs (letters, digits and signs that look like ASCII
ones; invisible characters vanish), HTML and URL escapes of @ and ., spelled digits ("five five
zero"), and at/dot disguises ("[at]", "(dot)", "name at host dot com").

Texts are read in Arrow batches of bounded bytes, one row at a time, without any shuffle. A text
without the characters or words that a transducer looks for passes it untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored where a digit run begins, so that long runs of digits cost one pass.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and a domain of two labels or more, found from each @ outwards."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end()))
                done = m.end()
        # Between two @ only: what stands before this one can't belong to the next.
        done = max(done, at + 1)
        at = text.find("@", done)
    return found


def _is_card(s: str) -> bool:
    d = [ord(c) - 48 for c in s if c not in " -"]
    twice = (2 * x - 9 * (x > 4) for x in d[-2::-2])
    return 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in s.split("."))


def _is_phone(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, leftmost and non-overlapping; matches that fail their check are dropped."""
    keep = lambda pattern, ok: [m.span() for m in pattern.finditer(text) if ok(m[0])]
    return {"email": emails(text), "ip": keep(_IP, _is_ip), "card": keep(_CARD, _is_card), "phone": keep(_PHONE, _is_phone) if "+" in text else []}


@dataclass
class Tape:
    """A rewritten text; ``starts[i]`` to ``ends[i]`` is the source of its character i."""

    text: str
    starts: list[int] | range
    ends: list[int] | range

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With each (start, end, new), in order and apart, put in place; all of ``new`` stands for all of what it replaces."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        return Tape("".join([*text, self.text[at:]]), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])

    def source(self, a: int, b: int) -> Span:
        return self.starts[a], self.ends[b - 1]


# Letters of other scripts that look like a Latin one.
_LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽє", "g": "ɡ", "h": "һ", "i": "іɩιı", "j": "јϳ", "k": "кκ", "l": "ӏⅼ", "m": "ⅿм", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵⅴ",
    "w": "ԝѡ", "x": "хχⅹ", "y": "уγү", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    ".": "․。｡", "-": "‐‑‒–—−﹣", " ": "              　", "": "­͏᠎​‌‍‎‏⁠﻿",
}


def _images() -> dict[str, str]:
    """Every character with an ASCII image: the look-alikes, decimal digits of all scripts, and forms that differ in width or font."""
    found = {c: a for a, cs in _LOOKALIKES.items() for c in cs}
    for code in range(0x80, 0x1FBFA):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            found[c] = str(unicodedata.digit(c))
        elif unicodedata.decomposition(c).startswith(("<wide>", "<font>", "<small>", "<circle>")) and c not in found:
            flat = unicodedata.normalize("NFKC", c)
            if len(flat) == 1 and flat.isascii() and flat.isprintable() and kind != "No":
                found[c] = flat
    return found


_IMAGE = _images()
_ODD = frozenset(_IMAGE)

_ESCAPES = {"@": r"&#0*64;|&#[xX]0*40;|&commat;|%40", ".": r"&#0*46;|&#[xX]0*2[eE];|&period;|%2[eE]"}
_ESCAPE = re.compile("|".join(f"({p})" for p in _ESCAPES.values()))

# Digits as words.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = rf"(?:{'|'.join(_DIGITS)})(?![A-Za-z0-9])"
_BETWEEN = r"[ ]+(?:dot|point|dash)[ ]+|[ ]*\.[ ]*|[ -]*[()][ -]*|[ -]+|,[ ]?"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ -]+)?(?:{_DIGIT}|[0-9]+)(?:(?:{_BETWEEN})(?:{_DIGIT}|[0-9]+)){{2,}}+", re.I)
_SPELLED_PART = re.compile(rf"(plus[ -]+)|({_DIGIT})|([ ]+(?:dot|point)[ ]+|[ ]*\.[ ]*)|([ ]+dash[ ]+)|([0-9]+)|({_BETWEEN})", re.I)

_OPEN, _CLOSE = r"[ ]*[\[({<][ ]*", r"[ ]*[\])}>][ ]*"
_BRACKETED = re.compile(rf"{_OPEN}(?:(at|@|ät|arroba)|(dot|\.|punkt|point|punto))(?:{_CLOSE})", re.I)
# Top-level domains that a host in plain words must end in.
_TOP = "com|net|org|edu|gov|info|biz|io|co|me|dev|app|ai|test|example|invalid|uk|us|de|fr|es|it|nl|ca|au|eu|ch|at|se|no|pl|ru|jp|cn|in|br"
_DOT = r"(?:[ ]+dot[ ]+|[ ]\.[ ]|\.)"
_DOTS = re.compile(_DOT, re.I)
_AT = re.compile(r"[ ]+at[ ]+|[ ]*@[ ]*", re.I)
_NAME = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,3}}\Z", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{0,4}}{_DOT}(?:{_TOP})(?![A-Za-z0-9-])", re.I)
_NAME_REACH = 160  # characters before "at" that a name may take
# Words that stand beside "at" and "dot" in plain prose and are no names of persons or hosts.
_PROSE = frozenset("a an the this that these those it he she they we you i us me them him her is are was were be been look looked looking point meet see not and or but of on in to for from by with as now back up at dot".split())


def unmask(tape: Tape) -> Tape:
    """Characters that look like ASCII ones become those, invisible ones vanish."""
    if tape.text.isascii():
        return tape
    odd = _ODD.intersection(tape.text)
    return tape.rewrite([(m.start(), m.end(), _IMAGE[m[0]]) for m in re.finditer("[" + re.escape("".join(sorted(odd))) + "]", tape.text)]) if odd else tape


def unescape(tape: Tape) -> Tape:
    """Escaped @ and . become plain."""
    if "&" not in tape.text and "%" not in tape.text:
        return tape
    return tape.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _ESCAPE.finditer(tape.text)])


def unspell(tape: Tape) -> Tape:
    """Runs of three digits or more of which one at least is spelled become digits without what stands between them."""
    low = tape.text.lower().replace("-", " ").replace(",", " ").replace(".", " ")
    if sum(low.count(f" {w}") for w in _DIGITS) < 2:
        return tape
    edits = []
    for run in _SPELLED.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(tape.text, run.start(), run.end()))
        if sum(bool(m[2]) for m in parts) < 3:
            continue
        for m in parts:
            new = "+" if m[1] else _DIGITS[m[2].lower()] if m[2] else "." if m[3] else "-" if m[4] else m[5] or ""
            edits.append((m.start(), m.end(), new))
    return tape.rewrite(edits)


def unhide(tape: Tape) -> Tape:
    """Bracketed at and dot become signs; then "name at host dot com" loses its words and spaces.

    Plain words are taken only as a whole address that ends in a known top-level domain, and where
    neither side is a word of common prose; with a plain dot in the host, "at" needs a digit, dot or
    underscore in the name, as "look at example.com" is prose.
    """
    low = tape.text.lower()
    if any(x in low for x in "[({<"):
        tape = tape.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(tape.text) if m.start() and m.end() < len(tape.text)])
    if " at " not in low and "@" not in tape.text:
        return tape
    edits: list[tuple[int, int, str]] = []
    for m in _AT.finditer(tape.text):
        host = _HOST.match(tape.text, m.end())
        from_ = max(m.start() - _NAME_REACH, 0)
        name = _NAME.search(tape.text[from_ : m.start()]) if host else None
        if not name or name.start() == 0 < from_ or edits and from_ + name.start() < edits[-1][1]:
            continue
        names, labels = _DOTS.split(name[0]), _DOTS.split(host[0])
        if m[0] == "@" and " " not in name[0] + host[0]:
            continue  # an address as it should be
        if "@" not in m[0] and " dot " not in host[0].lower() and not re.search(r"[0-9._]", name[0]):
            continue
        if _PROSE.intersection(x.lower() for x in (names[0], names[-1], labels[0])):
            continue
        edits += [(d.start() + name.start() + from_, d.end() + name.start() + from_, ".") for d in _DOTS.finditer(name[0])]
        edits.append((*m.span(), "@"))
        edits += [(d.start() + m.end(), d.end() + m.end(), ".") for d in _DOTS.finditer(host[0])]
    return tape.rewrite(edits)


def spans_of(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, added spans) of each kind. An added span takes in whole whatever base spans of its kind it meets, and more."""
    text = text or ""
    base, tape = base_spans(text), Tape.of(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    for step in (unmask, unescape, unspell, unhide):
        tape = step(tape)
    if tape.text != text:
        for kind, found in base_spans(tape.text).items():
            for a, b in (tape.source(*s) for s in found):
                met = [(x, y) for x, y in base[kind] if x < b and a < y]
                if (a, b) not in met and all(a <= x and y <= b for x, y in met):
                    added[kind].append((a, b))
    return base, added


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row: spans by kind as in KINDS, then start, in code points, end exclusive.

    A null or empty text has no spans. Rows that repeat an id each have a row; other columns are not read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, added = spans_of(text)
                rows.append([{"kind": k, "start": s, "end": e, "base": plain} for k in KINDS for s, e, plain in sorted([(*x, True) for x in base[k]] + [(*x, False) for x in added[k]])])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(kind))], ["id", "spans"])

    picked = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return picked.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans {_SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets, as in <EMAIL>.

    Spans of several kinds that overlap are one, named after the first kind of KINDS among them. A null text stays null.
    """
    names, schema = docs.columns, docs.schema

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, added = spans_of(text)
        out, at, merged = [], 0, []
        for s, e, k in sorted((s, e, i) for i, kind in enumerate(KINDS) for s, e in base[kind] + added[kind]):
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]), min(k, merged[-1][2]))
            else:
                merged.append((s, e, k))
        for s, e, k in merged:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(run, schema).select(*names)
