"""Personal data by offset-preserving deobfuscation.

A text goes through a chain of transducers: each replaces what it matches by one symbol, or by none, and keeps for
every symbol of its output the stretch of its input that it stands for. Composed, they give a normalised text whose
every symbol points into the source. In order: look-alike characters (compatibility forms, digits of any script,
Cyrillic and Greek letters shaped like Latin ones, dashes, dots) to ASCII; invisible characters to nothing; bracketed
and spoken "at" and "dot"; digits spelled out in English, French, German or Spanish; a spoken "plus". Identifiers are then
detected twice, in the source and in the normalised text. What the source has is *base*; what only the normalised text
has is *added*, if something of it was disguised, and its span is mapped back to source characters.

Detection finds the leftmost matches, one after the other, of four kinds, in time linear in the text: e-mail addresses from
each @ outwards, the others with quantifiers that never give back. A failing match (address parts over 255, a wrong
check digit, too many or few digits) is dropped and its characters are not tried again.

Spoken forms count in a telling place only, so that prose stays as it is: "at" needs a spoken dot behind it, a
digit's name another digit beside it, and nothing is reported that does not make up a whole identifier.

Each document is worked on by itself in one pass, without a shuffle; a batch holds at most ``BATCH_ROWS`` texts.

Defined results: a null text is an empty one and has no spans; offsets are code points, the end exclusive; bytes that are not
UTF-8 count as one replacement character each time decoding meets them; an added span that equals a base one of its kind is not repeated, but added
spans may overlap base ones; null and repeated ids and equal rows are rows of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,value:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())]))
BATCH_ROWS = 1024

# The four kinds. The e-mail's local part is looked for backwards from what _DOMAIN matches.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd, even = [int(c) for c in digits[::-1][::2]], [int(c) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def emails(text: str):
    floor = 0  # no match reaches back over this
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(floor, text.rfind("@", floor, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        floor = at + 1
        if start < at:
            yield start, m.end()
            floor = m.end()


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then by start."""
    out = [("email", a, z) for a, z in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


class Aligned:
    """A text and, for each of its characters, the stretch of the source that it stands for (None: itself)."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """With each stretch replaced by one character or none. Edits are in order and do not overlap."""
        if not edits:
            return self
        keep, pieces, at = np.ones(len(self.text), bool), [], 0
        for a, z, new in edits:
            keep[a + len(new) : z] = False
            pieces += (self.text[at:a], new)
            at = z
        pieces.append(self.text[at:])
        first = np.flatnonzero(keep)
        last = first.copy()
        one = [(a, z) for a, z, new in edits if new]
        if one:
            a, z = np.array(one).T
            last[np.searchsorted(first, a)] = z - 1
        if self.start is None:
            return Aligned("".join(pieces), first, last + 1)
        return Aligned("".join(pieces), self.start[first], self.end[last])

    def source(self, a: int, z: int) -> tuple[int, int]:
        return (a, z) if self.start is None else (int(self.start[a]), int(self.end[z - 1]))


# Letters of other scripts that look like Latin ones, and marks that look like a hyphen or a full stop.
_LOOKS = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "кκ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "-": "‐‑‒–—―−", ".": "·‧。｡",
}
_HIDDEN = re.compile(r"[\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufeff]+")
_NAMES = ("zero zéro null cero", "one un eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve")
_DIGIT = {name: str(d) for d, names in enumerate(_NAMES) for name in names.split()}
_DIGIT_NAME = re.compile(rf"\b(?:{'|'.join(sorted(_DIGIT))})\b", re.IGNORECASE)
_OPEN, _CLOSE = r" {0,2}[\[({<] {0,2}", r" {0,2}[\])}>] {0,2}"
_BRACKETED = re.compile(rf"{_OPEN}(?:(at|arobase|@)|dot|point|punkt|punto|\.){_CLOSE}", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPOKEN_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-]) at (?={_LABEL}(?:\.{_LABEL}){{0,8}} dot {_LABEL})", re.IGNORECASE)
_SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.IGNORECASE)
_SPOKEN_PLUS = re.compile(r"\bplus ?(?=[0-9])", re.IGNORECASE)


@cache
def look_alikes() -> tuple[dict[int, str], re.Pattern]:
    """The ASCII character that each look-alike stands for, and a pattern of all of them. Those whose compatibility
    form is one ASCII character, and digits of any script, come by rule."""
    out = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1FC00))):
        if (d := unicodedata.decimal(c, None)) is not None:
            out[c] = str(d)
        elif unicodedata.decomposition(c).startswith("<") and len(n := unicodedata.normalize("NFKC", c)) == 1 and (n in _LOCAL or n in "@ ()"):
            out[c] = n
    out |= {c: to for to, looks in _LOOKS.items() for c in looks}
    points = np.array(sorted(map(ord, out)))
    cuts = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    spans = "".join(f"{re.escape(chr(s[0]))}-{re.escape(chr(s[-1]))}" for s in cuts)
    return {ord(c): to for c, to in out.items()}, re.compile(f"[{spans}]")


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Names of digits with another digit or its name beside them, each with the separator before a next name."""
    found = [(m.start(), m.end(), _DIGIT[m.group().lower()]) for m in _DIGIT_NAME.finditer(text) if m.group().lower() in _DIGIT]
    out = []
    for i, (a, z, d) in enumerate(found):
        near = text[z : z + 1] in (" ", "-", ".")
        follows = near and i + 1 < len(found) and found[i + 1][0] == z + 1
        behind = near and text[z + 1 : z + 2].isdigit()
        before = text[a - 1 : a] in (" ", "-", ".", "+") and (text[a - 2 : a - 1].isdigit() or (i > 0 and found[i - 1][1] == a - 1)) if a >= 2 else False
        if follows or behind or before:
            out.append((a, z + 1 if follows and text[z] != "." else z, d))
    return out


def normalised(text: str) -> Aligned:
    """The text after all transducers."""
    out = Aligned(text)
    if not text.isascii():
        stands, some = look_alikes()
        if some.search(text):
            out = Aligned(text.translate(stands))
        out = out.rewritten([(m.start(), m.end(), "") for m in _HIDDEN.finditer(out.text)])
    if any(c in out.text for c in "[({<"):
        out = out.rewritten([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(out.text)])
    out = out.rewritten([(m.start(), m.end(), "@") for m in _SPOKEN_AT.finditer(out.text)])
    out = out.rewritten([(m.start(), m.end(), ".") for m in _SPOKEN_DOT.finditer(out.text)])
    out = out.rewritten(_spelled(out.text))
    return out.rewritten([(m.start(), m.end(), "+") for m in _SPOKEN_PLUS.finditer(out.text)])


def spans_of(text: str) -> list[dict]:
    """Base and added spans by kind, start and end, each with the identifier in plain characters."""
    base = detect(text)
    out = [(k, a, z, True, text[a:z]) for k, a, z in base]
    plain = normalised(text)
    if plain.text != text:
        have = set(base)
        for k, a, z in detect(plain.text):
            s, e = plain.source(a, z)
            if plain.text[a:z] != text[s:e] and (k, s, e) not in have:
                have.add((k, s, e))
                out.append((k, s, e, False, plain.text[a:z]))
        out.sort(key=lambda r: (KINDS.index(r[0]), r[1], r[2]))
    return [dict(zip(("kind", "start", "end", "base", "value"), r, strict=True)) for r in out]


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: an array of (kind, start, end, base, value) for each row."""

    def found(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                spans = [spans_of(t.as_py().decode("utf-8", "replace")) if t.is_valid else [] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _ARROW)], ["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(found, SCHEMA)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans (all, listed), n_added."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def masked(text: str | None, spans) -> str | None:
    """``text`` with each stretch that any span covers replaced by the kind of the first span there, in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += (text[at : s["start"]], f"[{s['kind']}]")
        at = max(at, s["end"])
    return "".join((*out, text[at:]))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with every span, base or added, masked."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [t.as_py().decode("utf-8", "replace") if t.is_valid else None for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([masked(t, spans_of(t or "")) for t in texts], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, text string")
