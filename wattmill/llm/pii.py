"""Personal data, also where it is disguised: texts are normalised by transducers that keep offsets, searched, and what is found is mapped back.

Base spans are the matches in the text as it is, leftmost and non-overlapping for each kind: email, ip (parts at most 255), card (13 to 19
digits that pass Luhn), phone (9 to 15 digits). A failing match is dropped without a retry.

Three transducers rewrite a text; each gives the new text and, for each piece of it, the place in the old one:
  - homoglyphs: wide, mathematical, Cyrillic and Greek look-alikes of ASCII letters, decimal digits of any script, look-alikes of @ . + - and special
    spaces become ASCII, invisible code points go;
  - at and dot: written in brackets, as character references or with spaces around the signs; as bare words (`name at host dot org`) only where
    a whole address of words follows, as `at` alone is a common word;
  - spelled digits: at least `LEAST_TOKENS` digits in words, groups of digits, `dot` and `plus` in a row, of which `LEAST_SPELLED` are words.
The same patterns search the rewritten text. A match there is added if something in it was rewritten and no base span of its kind holds it
already; its span goes from the source of its first code point to the end of the source of its last. Base spans always stay.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Texts are read whole, in time in proportion to their length, and held by one
task with their rewritten form. Repeated rows get the same result each. A null doc_id is kept. Empty tables give no rows. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As `[0-9]+(\.[0-9]+){3}`, but tried at the start of a row of digits only, where it matches if it does anywhere in the row.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGIT, DIGIT_DOT = re.compile("[0-9]"), re.compile(r"[0-9]\.[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words for digits in English, German, French and Spanish, for at, for dot and for plus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto"), ("plus", "más")
#: Cyrillic and Greek letters and the ASCII letters that they look like.
LOOKALIKES = dict(zip("аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅԁһԛԝαΑΒεΕΖΗιΙκΚΜνΝοΟρΡτΤυΥΧ", "aABBeEkKmMHHoOpPcCtTyYxXiIjJsSdhqwaABeEZHiIkKMvNoOpPtTuYX"))
#: Look-alikes of signs.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "﹒": ".", "｡": ".", "＋": "+", "﹢": "+", "‐": "-", "\u2011": "-", "‒": "-", "–": "-", "−": "-", "－": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " "}
#: Code points that aren't seen.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

LEAST_TOKENS, LEAST_SPELLED = 4, 3
#: Words from a digit word to the next one in a row: groups of digits and `dot` may stand between.
MOST_APART = 24
#: One of these is in whatever `AT_DOT` rewrites (in lower case, tabs as spaces).
AT_DOT_SIGNS = ("[", "(", "{", "<", "&", " @", "@ ", *(f" {w} " for w in DOT_WORDS), " . ")
_WORD = r"[A-Za-z0-9-]+"
_AT, _DOT, _PLUS, _DIGIT = (rf"(?:{'|'.join(sorted(w, key=len, reverse=True))})" for w in (AT_WORDS, DOT_WORDS, PLUS_WORDS, DIGIT_WORDS))
_GAP = r"[\x20\t]{1,3}"
#: What ends the name before a bare `at`, and the address of words that must follow it.
_ADDRESS = rf"(?={_WORD}(?:{_GAP}{_DOT}{_GAP}{_WORD})*{_GAP}{_DOT}{_GAP}[A-Za-z]{{2,24}}\b)"
AT_DOT = re.compile(
    rf"(?P<at>[\x20\t]{{0,3}}(?:[\[({{<][\x20\t]?(?:{_AT}|@)[\x20\t]?[\])}}>]|&(?:\#0*64|\#x0*40|commat);)[\x20\t]{{0,3}}|(?<=[A-Za-z0-9_]){_GAP}{_AT}{_GAP}{_ADDRESS}|(?<=[A-Za-z0-9_]){_GAP}@[\x20\t]{{0,3}}(?={_WORD}(?:\.|{_GAP}[.\[({{<]|{_GAP}{_DOT}{_GAP}))|(?<=[A-Za-z0-9_])@{_GAP}(?={_WORD}(?:\.|{_GAP}[.\[({{<]|{_GAP}{_DOT}{_GAP})))"
    rf"|(?P<dot>[\x20\t]{{0,3}}(?:[\[({{<][\x20\t]?(?:{_DOT}|\.)[\x20\t]?[\])}}>]|&(?:\#0*46|\#x0*2e|period);)[\x20\t]{{0,3}}|(?<=[A-Za-z0-9]){_GAP}(?:{_DOT}|\.){_GAP}(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
#: Places at which `AT_DOT` could say anything: a cheap test for whole texts.
AT_DOT_HINT = re.compile(rf"[\[({{<][\x20\t]?(?:{_AT}|{_DOT}|@|\.)[\x20\t]?[\])}}>]|&(?:\#|commat|period)|[\x20\t]@|@[\x20\t]|[\x20\t]{_DOT}[\x20\t]", re.IGNORECASE)
_TOKEN = rf"(?:\b{_DIGIT}\b|[0-9]{{1,4}}(?![0-9]))"
_JOINT = rf"(?:[\x20\t]{{1,3}}|-|,[\x20]?|[\x20]?\.[\x20]?)"
SPELLED = re.compile(rf"(?:(?:\b{_PLUS}\b[\x20\t]{{1,3}}|\+[\x20\t]{{0,3}})?)(?<![0-9A-Za-z]){_TOKEN}(?:{_JOINT}(?:{_DOT}\b{_JOINT})?{_TOKEN}){{{LEAST_TOKENS - 1},}}", re.IGNORECASE)
SPELLED_TOKEN = re.compile(rf"(?P<digit>\b{_DIGIT}\b)|(?P<number>[0-9]+)|(?P<dot>\b{_DOT}\b|\.)|(?P<plus>\b{_PLUS}\b|\+)", re.IGNORECASE)
SPELLED_HINT = re.compile(rf"\b{_DIGIT}\b{_JOINT}(?:{_DOT}{_JOINT})?{_TOKEN}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether the weighted sum of the digits ends in zero: every second one from the right counts twice, its own digits added."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Sought from each @: names are looked up leftwards to the end of the match before, so long rows of letters aren't read again and again."""
    at, before = text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        before = found.end() if found else at + 1
        at = text.find("@", before)


def _matches(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans (kind's number, start, end) of a text as it is."""
    for start, end in _emails(text):
        yield 0, start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text) if DIGIT_DOT.search(text) else ():
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield 1, *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield 2, *m.span()
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield 3, *m.span()
        at = text.find("+", m.end() if m else at + 1)


class Rewritten:
    """A text after edits (start, end, new), with the way back to the places of the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        pieces, self.new, self.old, at, length = [], [], [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for a, b, piece, kept in ((at, start, text[at:start], True), (start, end, new, False)):
                if piece:
                    self.new.append(length)
                    self.old.append((a, b, kept))
                    pieces.append(piece)
                    length += len(piece)
            at = end
        self.text = "".join(pieces)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span before the edits, and whether an edit lies in it."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        (a, _, kept_a), (c, d, kept_c) = self.old[i], self.old[j]
        first = a + start - self.new[i] if kept_a else a
        last = c + end - self.new[j] if kept_c else d
        return first, last, i != j or not kept_a


@cache
def homoglyphs() -> dict[str, str]:
    """What looks like an ASCII letter, digit or sign: the fixed values, and by Unicode's own rules whatever is a decimal digit or a compatible form of one ASCII letter or digit."""
    table = {**LOOKALIKES, **SIGNS, **dict.fromkeys(INVISIBLE, "")}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table.setdefault(c, str(digit))
        elif 0x1D400 <= code <= 0x1D7FF or 0xFF00 <= code <= 0xFF5E or 0x2460 <= code <= 0x24FF or 0x2100 <= code <= 0x214F:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                table.setdefault(c, plain)
    return table


def plain_letters(text: str) -> list[tuple[int, int, str]]:
    """Edits of the first transducer."""
    if text.isascii():
        return []
    table = homoglyphs()
    there = table.keys() & set(text)
    if not there:
        return []
    return [(m.start(), m.end(), table[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, sorted(there))) + "]", text)]


def plain_signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of the second transducer."""
    plain = text.lower().replace("\t", " ")
    if not any(sign in plain for sign in AT_DOT_SIGNS) or not AT_DOT_HINT.search(plain):
        return []
    return [(*m.span(), "@" if m["at"] else ".") for m in AT_DOT.finditer(text)]


def has_spelled_row(text: str) -> bool:
    """Whether digit words stand near each other: a test of words, much cheaper than the pattern."""
    words = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split()
    if DIGIT_WORDS.keys().isdisjoint(words):
        return False
    at = [i for i, w in enumerate(words) if w in DIGIT_WORDS]
    return any(b - a <= MOST_APART for a, b in zip(at, at[1:]))


def plain_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits of the third transducer."""
    if not has_spelled_row(text):
        return []
    edits = []
    for hint in SPELLED_HINT.finditer(text):
        if edits and hint.start() < edits[-1][1]:
            continue
        m = SPELLED.search(text, max(0, hint.start() - 24, edits[-1][1] if edits else 0), hint.start() + 400)
        if m and sum(1 for t in SPELLED_TOKEN.finditer(m[0]) if t["digit"]) >= LEAST_SPELLED:
            signs = {"dot": ".", "plus": "+"}
            edits.append((*m.span(), "".join(DIGIT_WORDS[t[0].lower()] if t["digit"] else signs.get(t.lastgroup, t[0]) for t in SPELLED_TOKEN.finditer(m[0]))))
    return edits


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (plain_letters, plain_signs, plain_digits)


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """All spans (kind's number, start, end, added) of a text, by kind, then start, then end."""
    base = [(*m, False) for m in _matches(text)]
    steps, now = [], text
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    added = set()
    for kind, start, end in _matches(now) if steps else ():
        touched = False
        for step in reversed(steps):
            start, end, edited = step.source(start, end)
            touched |= edited
        if touched and not any(k == kind and a <= start and end <= b for k, a, b, _ in base):
            added.add((kind, start, end, True))
    return sorted([*base, *added])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, spans (array of kind, start, end, added, and the text's own characters there)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = (t.as_py() or "" for t in batch.column("text"))
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "added": new, "value": text[a:b]} for k, a, b, new in spans(text)] for text in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, found)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,added:boolean,value:string>>")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, the base spans' number by kind, base_sha256, all spans, n_added."""
    told = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    base = F.filter("spans", lambda s: ~s.added)
    count = lambda kind: F.size(F.filter("spans", lambda s: ~s.added & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return personal_data(docs).select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: s.added)).cast("long").alias("n_added"),
    )
