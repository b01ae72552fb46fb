"""Personal data with offset-preserving deobfuscation.

Base spans follow four fixed patterns over the text as it is. A transducer then rewrites the text:
look-alike characters become ASCII (one for one), invisible characters go, runs of spelled digits
become digits, and "at" and "dot" disguises become @ and dots. Each rewritten character knows the
source span it came from, so what the patterns find in the rewritten text is mapped back to
source offsets. A span is added when it isn't within a base span of its kind.

Defined results: null or empty texts have no spans; null doc_ids and repeated rows are treated as any
row; an empty table gives no rows; extra columns are ignored. Matching is linear in the text:
emails are found from their @ signs, digit runs are entered only at their start.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failing start within a digit run fails at all its later digits too, and a match ends a run.
IP_HINT = re.compile(r"[0-9]\.[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Letters of other scripts that look like these ASCII letters.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H",
    "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "ӏ": "l", "М": "M", "о": "o", "О": "O", "р": "p",
    "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "Т": "T", "ѵ": "v", "ԝ": "w", "х": "x", "Х": "X", "у": "y",
    "У": "Y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "ο": "o", "Ρ": "P", "ρ": "p", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ν": "v", "ι": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "​‌‍⁠﻿­"
#: Digits as words, in the corpus's four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _alike() -> dict[str, str]:
    """LOOKALIKES, and by rule every character whose compatibility form or digit value is one ASCII character."""
    found = {}
    for first, last in ((0x2070, 0x209F), (0x2460, 0x249B), (0x24B6, 0x24FF), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F), (0xFE52, 0xFE6B)):
        for c in map(chr, range(first, last + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                found[c] = plain
            elif unicodedata.digit(c, None) is not None:
                found[c] = str(unicodedata.digit(c))
    return found | LOOKALIKES


ALIKE = _alike()
#: No character that ALIKE or INVISIBLE has is among these, but for the soft hyphen.
PLAIN_ONLY = re.compile("[^\\x00-\\x9f\\xa1-\\xac\\xae-\\u024f]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_EDGE_L, _EDGE_R = r"(?<![^\W_])", r"(?![^\W_])"
#: Two digits or more in a row, one of them spelled, with single spaces, hyphens or commas between.
DIGITS = re.compile(rf"{_EDGE_L}(?:(?:{_WORD}){_EDGE_R}|[0-9](?=[ ,-]{{1,2}}(?:{_WORD}){_EDGE_R}))(?:[ ,-]{{1,2}}(?:(?:{_WORD})|[0-9]){_EDGE_R})+", re.I)
#: A quick look at the lower-cased text: what DIGITS needs at least, whatever stands at its edges.
DIGITS_HINT = re.compile(rf"(?:{_WORD})[ ,-]{{1,2}}(?:{_WORD}|[0-9])|[0-9][ ,-]{{1,2}}(?:{_WORD})")
#: Letters that DIGITS takes for an i or s without regard to case, though lower() doesn't.
FOLDED = "İıſ"
#: What stays of each spelled digit, to its right end, where all but ASCII letters and digits are white space.
ENDINGS = frozenset(re.split("[^a-z]", w)[-1].encode() for w in SPELLED)
LETTERS_ONLY = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + b" " * 128
DIGIT = re.compile(rf"{_WORD}|[0-9]", re.I)
#: A single spelled digit counts next to a spelled dot.
DOTTED = re.compile(rf"(?<=\bdot )(?:{_WORD}){_EDGE_R}|{_EDGE_L}(?:{_WORD})(?= dot )", re.I)
#: Letters that stand in for digits between digits.
FALSE_DIGITS = re.compile(r"[0-9][OolI]{1,3}(?=[0-9])")
PLUS = re.compile(rf"{_EDGE_L}plus[ ]+(?=[0-9])", re.I)
#: at and dot in brackets, with or without spaces around.
AT = re.compile(r"\s{0,3}(?:\(\s?(?:at|@|ät|arroba|arobase)\s?\)|\[\s?(?:at|@|ät|arroba|arobase)\s?\]|\{\s?(?:at|@|ät|arroba|arobase)\s?\}|<\s?(?:at|@)\s?>)\s{0,3}", re.I)
DOT = re.compile(r"\s{0,3}(?:\(\s?(?:dot|\.|punkt|punto|point)\s?\)|\[\s?(?:dot|\.|punkt|punto|point)\s?\]|\{\s?(?:dot|\.|punkt|punto|point)\s?\}|<\s?(?:dot|\.)\s?>)\s{0,3}", re.I)
#: Bare words count only between what can be parts of an address, and "at" only with a spelled dot after it.
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9]) (?:dot|punkt|punto) (?=[A-Za-z0-9])", re.I)
BARE_AT = re.compile(r"(?<=[A-Za-z0-9_%+-]) (?:at|arroba|arobase|ät) (?=[A-Za-z0-9-]+(?: (?:dot|punkt|punto) (?!dot|punkt|punto)| ?[\[({<]\s?(?:dot|\.|punkt|punto|point)))", re.I)
#: Before a plain domain, "at" needs a word that reads like an address: a letter first, then a sign or digit.
LIKE_AT = re.compile(r"(?<![^\s(<\[\"',;:])([A-Za-z][A-Za-z0-9._%+-]*+)( at )(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[a-z]{2,6}\b)")
SIGN = re.compile(r"[0-9._%+-][A-Za-z0-9]|[0-9]$")
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-]) ?@ ?(?=[A-Za-z0-9-]+(?:\.| dot | ?[\[({<]\s?(?:dot|\.)))", re.I)
HINT = re.compile(rf"{_EDGE_L}(?:dot|punkt|punto){_EDGE_R}|[\[({{<]\s?(?:at|@|ät|arroba|arobase|\.)\s?[\])}}>]| @|@ ", re.I)


SPELLED_DOTS = (" dot ", " punkt ", " punto ")
BRACKETS = ("[", "(", "{", "<", " @", "@ ")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the leftmost non-overlapping search finds, from the @ signs."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end()))
        floor = end
        at = text.find("@", end)
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text) if IP_HINT.search(text) else ():
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Tape:
    """Rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new), in order, apart; each new character stands for the whole edited span."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            if e > s:
                starts += [self.starts[s]] * len(new)
                ends += [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def sub(self, pattern: re.Pattern, new: str) -> None:
        self.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(self.text)])

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """One edit a digit; what stands between two digits goes to the first."""
    parts = list(DIGIT.finditer(m[0]))
    return [(m.start() + p.start(), m.start() + (parts[i + 1].start() if i + 1 < len(parts) else p.end()), SPELLED.get(p[0].lower(), p[0])) for i, p in enumerate(parts)]


def may_spell(low: str) -> bool:
    """False only where DIGITS finds nothing in the text that low is the lower case of, but for FOLDED."""
    return not ENDINGS.isdisjoint(low.encode("ascii", "replace").translate(LETTERS_ONLY).split()) and DIGITS_HINT.search(low) is not None


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Single digits, each with its own source span; separators between them are dropped."""
    out = []
    for m in DIGITS.finditer(text):
        edits = spelled(m)
        for i, (s, e, d) in enumerate(edits):
            stop = e if i + 1 == len(edits) else s + len(DIGIT.match(text, s)[0])
            out.append((s, stop, d))
            if stop < e:
                out.append((stop, e, ""))
    return out


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in source offsets."""
    tape = Tape(text)
    if not text.isascii() and PLAIN_ONLY.search(text):
        # One for one where a character has a look-alike, none for the invisible.
        tape.rewrite([(i, i + 1, ALIKE.get(c, "")) for i, c in enumerate(text) if c in ALIKE or c in INVISIBLE])
    low = tape.text.lower()
    dots = any(x in low for x in SPELLED_DOTS)
    if dots:
        tape.rewrite([(m.start(), m.end(), SPELLED[m[0].lower()]) for m in DOTTED.finditer(tape.text)])
    if dots or may_spell(low) or any(c in tape.text for c in FOLDED):
        tape.rewrite(digit_edits(tape.text))
    tape.rewrite([(i, i + 1, "0" if tape.text[i] in "Oo" else "1") for m in FALSE_DIGITS.finditer(tape.text) for i in range(m.start() + 1, m.end())])
    if "plus" in low:
        tape.sub(PLUS, "+")
    if " at " in tape.text:
        tape.rewrite([(*m.span(2), "@") for m in LIKE_AT.finditer(tape.text) if SIGN.search(m[1])])
    if (dots or any(x in tape.text for x in BRACKETS)) and HINT.search(tape.text):
        for pattern, new in ((BARE_AT, "@"), (AT, "@"), (SPACED_AT, "@"), (DOT, "."), (BARE_DOT, ".")):
            tape.sub(pattern, new)
    if tape.starts is None:
        return []
    found = set()
    for s, k, e in spans(tape.text):
        a, b = tape.source(s, e)
        if not any(k == k2 and a2 <= a and b <= b2 for a2, k2, b2 in base):
            if tape.text[s:e] != text[a:b]:  # else an unchanged stretch that the base search saw and refused
                found.add((a, k, b))
    return sorted(found)


def digest(text: str) -> tuple[list[int], str, str, int]:
    base = spans(text)
    more = added(text, base)
    write = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    return counts, hashlib.sha256(write(base).encode()).hexdigest(), write(sorted([*base, *more])), len(more)


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts of each kind, base_sha256, spans (base and added) and n_added for every row."""

    def run(batches):
        for b in batches:
            rows = [digest(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)]
            rest = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *rest], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return common.texts(docs).transform(common.in_workers, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return found_in(common.table(spark, sf_dir, "documents"))
