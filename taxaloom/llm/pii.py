"""Personal data in texts, disguised or not, with offsets into the source."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

KINDS = ("email", "ip", "card", "phone")
HIDDEN = tuple(f"hidden_{k}" for k in KINDS)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like these.
LOOKALIKES = {
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іι", "j": "ј", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "。․", "-": "‐‑‒–−", "@": "﹫",
}
#: Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "plus": "+", "un": "1", "une": "1", "ein": "1", "eine": "1",
}
#: Words that say how often the digit behind them comes.
TIMES = {"double": 2, "triple": 3, "treble": 3}
AT, DOT = "at|arroba|arobase", "dot|punkt|point|punto"
#: Ends of domains, but for those that are words of running text.
ENDS = frozenset("com org net edu gov mil int info biz name io dev app eu de fr es uk ca ch nl se dk pl ru jp cn br au nz ie pt".split())
#: What is said before an address: behind one of these "bob at example.com" is one, and not only a place.
CUE = re.compile(r"(?i)\b(?:e-?mail|mail|courriel|correo|contact|kontakt|write|reach|address|adresse|reply)\b[^.!?\n]{0,24}$")
#: The fewest digits of any kind, an address of four.
LEAST_DIGITS = 4


def _glyphs() -> dict[str, str]:
    table = {g: c for c, many in LOOKALIKES.items() for g in many}
    for block in (range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2460, 0x2474), range(0x24B6, 0x24EA), range(0x660, 0x66A), range(0x6F0, 0x6FA), range(0x966, 0x970), range(0x2070, 0x208A)):
        for point in block:
            plain = unicodedata.normalize("NFKC", chr(point))
            if not plain.isascii() and unicodedata.decimal(chr(point), None) is not None:
                plain = str(unicodedata.decimal(chr(point)))
            if len(plain) == 1 and plain.isascii():
                table[chr(point)] = plain
    return table


class Transducers:
    """Rewrites of disguises: each step maps a text to another and keeps where its characters come from."""

    def __init__(self) -> None:
        self.glyphs = _glyphs()
        self.glyph = re.compile("[" + "".join(map(re.escape, self.glyphs)) + "]")
        words = "|".join(sorted(SPELLED, key=len, reverse=True))
        times = rf"(?:(?:{'|'.join(TIMES)})[ \t]{{1,2}})?"
        self.number = re.compile(rf"(?i)\b(?:(?:{times}(?:{words})|\+?[0-9]+)\b[ \t,.\-]{{0,2}})++")
        self.spelled = re.compile(rf"(?i)\b(?:(plus)\b[ \t]*|(?:({'|'.join(TIMES)})[ \t]{{1,2}})?({words})\b)")
        wrap = lambda w: rf"[ \t]?[\[({{<][ \t]?(?:{w})[ \t]?[\])}}>][ \t]?"
        dotted = rf"(?:[ \t](?:{DOT})[ \t]|{wrap(DOT + '|[.]')})"
        domain = rf"[A-Za-z0-9-]+(?:(?:\.|{dotted})[A-Za-z0-9-]+)*{dotted}[A-Za-z0-9-]+"
        self.at = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])(?:{wrap(AT + '|@')}|[ \t](?:{AT})[ \t](?={domain}))(?=[A-Za-z0-9])")
        self.domain = re.compile(rf"(?i){domain}")
        self.dot = re.compile(rf"(?i)(?<=[A-Za-z0-9]){dotted}(?=[A-Za-z0-9])")
        part = rf"(?:[0-9]{{1,3}}|{times}(?:{words})\b(?:[ \t\-]{times}(?:{words})\b){{0,2}})"
        self.address = re.compile(rf"(?i)(?<![0-9.])\b{part}(?:(?:\.|{dotted}){part}){{3}}(?![0-9])")
        named = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
        self.place = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])[ \t]({AT})[ \t](?={named}\b)")
        #: What a text needs for each step to do anything, without look-around, for Arrow's linear-time matcher.
        several = rf"(?:{words})\b[ \t,.\-]{{0,2}}\b(?:{'|'.join(TIMES)}|{words}|[0-9])|(?:{words})\b[ \t,.\-]{{0,2}}\+[0-9]|[0-9][ \t,.\-]{{0,2}}\b(?:{'|'.join(TIMES)}|{words})\b|\b(?:{'|'.join(TIMES)})[ \t]{{1,2}}(?:{words})\b"
        apart = rf"(?:{words}|[0-9])(?:\.|{dotted})(?:{words})\b|\b(?:{words})(?:\.|{dotted})[0-9]"
        self.needs = ["[" + "".join(map(re.escape, self.glyphs)) + "]", rf"(?i)\b{several}|{apart}", rf"(?i)[A-Za-z0-9_%+\-](?:{wrap(AT + '|@')}|[ \t](?:{AT})[ \t](?:{domain}|{named}))", rf"(?i)(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{dotted}[A-Za-z0-9]|[0-9]{dotted}[0-9])"]

    def _digits(self, text: str) -> list[tuple[int, int, str]]:
        """Spelled digits of runs long enough for an identifier; blanks and hyphens between two of them go."""
        whole = [(m.start(), m.end()) for m in self.address.finditer(text)]
        runs = [(m.start(), m.end()) for m in self.number.finditer(text)]
        out = []
        for start, end, is_address in sorted([(*r, True) for r in whole] + [(*r, False) for r in runs if not any(a < r[1] and r[0] < b for a, b in whole)]):
            said = list(self.spelled.finditer(text, start, end))
            many = [TIMES[w[2].casefold()] if w[2] else 1 for w in said]
            if not said or (not is_address and len(re.findall("[0-9]", text[start:end])) + sum(n for w, n in zip(said, many, strict=True) if not w[1]) < LEAST_DIGITS):
                continue
            for k, (w, n) in enumerate(zip(said, many, strict=True)):
                if k and not w[1] and not said[k - 1][1] and w.start() > said[k - 1].end() and not text[said[k - 1].end() : w.start()].strip(" \t-"):
                    out.append((said[k - 1].end(), w.start(), ""))
                out.append((w.start(), w.end(), "+" if w[1] else SPELLED[w[3].casefold()] * n))
        return out

    def _ats(self, text: str) -> list[tuple[int, int, str]]:
        """Disguised at signs. A bare word before a domain with plain dots is one if it is in capitals, if the name before it
        has a dot, a digit or the like, or if the words before tell of an address; else it may be a place. Where the
        dots are bare words too, "at one point and" and "at 12 Dot Lane" are none."""
        found = {(m.start(), m.end()) for m in self.at.finditer(text) if not m[0].strip().isalpha() or self._is_domain(text, m.end())}
        for m in self.place.finditer(text):
            start = m.start()
            while start and text[start - 1] in LOCAL_SET:
                start -= 1
            if m[1].isupper() or re.search("[0-9._%+-]", text[start : m.start()]) or CUE.search(text, max(0, start - 40), start):
                found.add((m.start(), m.end()))
        return [(a, b, "@") for a, b in sorted(found)]

    def edits(self, text: str, step: int) -> list[tuple[int, int, str]]:
        if step == 0:
            return [] if text.isascii() else [(m.start(), m.end(), self.glyphs[m[0]]) for m in self.glyph.finditer(text)]
        if step == 1:
            return self._digits(text)
        return self._ats(text) if step == 2 else [(m.start(), m.end(), ".") for m in self.dot.finditer(text)]

    def _is_domain(self, text: str, at: int) -> bool:
        """Whether what stands behind a bare word for the at sign reads as a domain, by its last part, its first one and its dots."""
        said = self.domain.match(text, at)[0]
        dots = [m[0].strip().lower() for m in self.dot.finditer(said)]
        if not all(d.isalpha() for d in dots):
            return True
        labels = re.split(r"[ .]+", said)
        return labels[-1].lower() in ENDS or (not labels[0].isdigit() and set(dots) == {"dot"})

    def normalise(self, text: str, first: int = 0) -> tuple[str, list[Rewritten]]:
        """The text after all steps from the first one on that it has a need of, and the steps that changed it."""
        steps = []
        for step in range(first, 4):
            found = self.edits(text, step)
            if found:
                steps.append(Rewritten(text, found))
                text = steps[-1].text
        return text, steps


class Rewritten:
    """A text after edits, and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        out, at = [], 0
        for start, end, new in edits:
            out += [text[at:start], new]
            at = end
        self.text = "".join(out) + text[at:]
        shrink = list(accumulate((e - s - len(n) for s, e, n in edits), initial=0))
        self.edits = edits
        self.shrink = shrink
        self.starts = [s - d for (s, _, _), d in zip(edits, shrink, strict=False)]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span's place before the edits, and whether it has any."""
        a = bisect.bisect_right(self.starts, start) - 1
        b = bisect.bisect_right(self.starts, end - 1) - 1
        inside = lambda k, p: k >= 0 and p < self.starts[k] + len(self.edits[k][2])
        left = self.edits[a][0] if inside(a, start) else start + self.shrink[a + 1]
        right = self.edits[b][1] if inside(b, end - 1) else end + self.shrink[b + 1]
        return left, right, b > a or inside(a, start)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: What a text needs to hold a plain identifier of each kind, for Arrow's matcher.
NEEDS = ("@[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "[0-9](?:[ -]?[0-9]){13}", r"\+[0-9]")


def detect(text: str, kinds: Sequence[bool] = (True,) * len(KINDS)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, leftmost and without overlap in each kind; kinds says which may occur."""
    out, done, at = [], 0, text.find("@") if kinds[0] else -1
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text) if kinds[1] else ():
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text) if kinds[2] else ():
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if kinds[3] else ():
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def find_all(text: str, rewrite: Transducers, first: int = 0) -> list[tuple[int, int, int]]:
    """Plain spans, and those that show only once disguises are undone (kinds from len(KINDS) on)."""
    base = detect(text)
    plain, steps = rewrite.normalise(text, first)
    if not steps:
        return base
    out = list(base)
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
    for start, kind, end in detect(plain):
        edited = False
        for step in reversed(steps):
            start, end, here = step.source(start, end)
            edited |= here
        spans = taken[kind]
        k = bisect.bisect_left(spans, (end, 0))
        if edited and not (k and spans[k - 1][1] > start):
            out.append((start, len(KINDS) + kind, end))
    return sorted(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<start, kind, end>>: code points, end exclusive, by start, then kind.

    Kinds are places in KINDS + HIDDEN. Plain spans always stay; a disguised one is
    added if undoing homoglyphs, spelled digits or at/dot words was needed to see it
    and no plain span of its kind touches it. Null texts have no spans, a null id
    stays null, repeated rows are each scanned, an empty table gives no rows. Work on
    a text grows with its length; other columns are not read; nothing is shuffled.
    """
    kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Transducers()
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            may = np.stack([pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False) for p in (*NEEDS, *rewrite.needs)], axis=1)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(may.any(axis=1)):
                whole, plain = text[int(k)].as_py(), may[k, : len(KINDS)]
                steps = np.flatnonzero(may[k, len(KINDS) :])  # an earlier step leaves the text as it is
                found[k] = find_all(whole, rewrite, int(steps[0])) if len(steps) else detect(whole, plain)
            spans = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])
        X.settle()

    return X.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,end:int>>")


def digests(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS + HIDDEN])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS + HIDDEN)]
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return found.select("doc_id", *counts[: len(KINDS)], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), *counts[len(KINDS) :])


def _of_kind(k: int):
    return lambda s: s["kind"] == k
