"""Benchmark decontamination by the q-gram lemma, with banded alignment to verify."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import storage

#: Characters in a gram, and edits allowed for each character of an item.
Q, ERROR = 10, 0.08
#: UTF-8 bytes of the benchmark that one pass over the documents carries; tasks hold some 25 times this. A larger benchmark takes more passes.
PASS_BYTES = 4 << 20
FILTER_BITS = 22
#: Places of a stretch of texts whose grams are counted at once, and gram pairs among them.
STRETCH, PAIRS = 1 << 16, 1 << 20
#: A gram that occurs so often in the items is looked at only now and then inside a run of one character.
OFTEN = 8
#: Neighbouring bands from which on they are aligned together, and diagonals that are aligned at once.
RUN, WIDE = 6, 1 << 15
SCHEMA = "doc_id long, item_id long, start int, end int, edits int"
FOLDED = {c: c + 32 for c in range(65, 91)} | dict.fromkeys(range(9, 14), 32)
FOLD = np.array([FOLDED.get(c, c) for c in range(256)], np.uint8)


def fold(text: str) -> str:
    """A-Z as a-z and white space as spaces; the number of characters stays."""
    return text.translate(FOLDED)


def bytes_of(text: str) -> np.ndarray:
    """A folded byte for each character, one and the same for all beyond Latin-1: equal characters have equal bytes, so grams of bytes miss nothing."""
    return FOLD[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def points(text: str) -> np.ndarray:
    return np.frombuffer(fold(text).encode("utf-32-le"), np.uint32)


def budget(m: int) -> int:
    """Edits that an item of m characters may have and still share a gram in any case."""
    return max(0, min(int(m * ERROR), (m - Q) // Q))


def grams(raw: np.ndarray) -> np.ndarray:
    """A number for the Q bytes from each place on, equal for equal bytes."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    head = np.ndarray((n,), "<u8", raw, strides=(1,))
    tail = np.ndarray((n,), "<u2", raw, offset=Q - 2, strides=(1,))
    return head * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """The benchmark items of one pass, their grams ascending, and a bit table that most other grams fail."""

    ids: list[int | None]
    items: list[str]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    step: np.ndarray  # of each key: the narrowest strip of the items that have it
    short: list[int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Index:
        given = [(i, x) for i, text in rows if (x := fold(text or "").strip(" "))]
        items = [x for _, x in given]
        every = [grams(bytes_of(x)) for x in items]
        keys = np.concatenate([np.zeros(0, np.uint64), *every])
        order = np.argsort(keys, kind="stable")
        table = np.zeros(1 << FILTER_BITS, bool)
        table[keys >> np.uint64(64 - FILTER_BITS)] = True
        edits = np.array([budget(len(x)) for x in items], np.int64)
        need = np.array([len(x) - Q + 1 for x in items], np.int64) - Q * edits
        owner = np.repeat(np.arange(len(items)), [len(e) for e in every])[order] if items else np.zeros(0, np.int64)
        places = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(e)) for e in every)])[order]
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        step = np.repeat(np.minimum.reduceat(edits[owner] + 1, first), np.diff(np.append(first, len(keys)))) if len(keys) else np.zeros(0, np.int64)
        return cls([i for i, _ in given], items, keys, owner, places, table, edits, need, step, [k for k, x in enumerate(items) if len(x) < Q])


def align(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """The least edits of the item against a stretch of the text that starts anywhere in a band, and where it ends.

    The band has the diagonals low to low + width - 1 (text place less item place).
    """
    far = np.int32(1 << 20)
    padded = np.full(width + len(item) + 1, 0, np.int32)
    lo, hi = max(0, low), min(len(text), low + width + len(item))
    if hi <= lo:
        return int(far), 0
    padded[lo - low : hi - low] = text[lo:hi].astype(np.int32) + 1  # 0 lies outside
    steps = np.arange(width, dtype=np.int32)
    # Rows hold edits less the step in the band, so that a move along a row costs nothing.
    row = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, far).astype(np.int32) - steps
    for i, c in enumerate(item.astype(np.int32) + 1):
        best = row + (padded[i : i + width] != c)
        np.minimum(best[:-1], row[1:] + 2, out=best[:-1])
        first, last = -(i + 1 + low), len(text) - (i + 1 + low)  # the steps that lie in the text
        if first > 0:
            best[:first] = far
        if last < width - 1:
            best[max(0, last + 1) :] = far
        row = np.minimum.accumulate(best, out=best)
    row = row + steps
    k = int(row.argmin())
    return int(row[k]), low + k + len(item)


def verify(index: Index, item: int, text: str, band: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the item in the band of the text, if within its budget."""
    raw, e = index.items[item], int(index.edits[item])
    w, m = e + 1, len(raw)
    low, width = band * w - e, 2 * w + 2 * e
    lo = max(0, low)
    near = text[lo : max(lo, low + width + m)]
    exact = fold(near).find(raw)
    if exact >= 0:
        return lo + exact, lo + exact + m, 0
    # Each character that the item has more often than the stretch takes an edit.
    lacking = np.bincount(bytes_of(raw), minlength=256) - np.bincount(bytes_of(near), minlength=256)
    if lacking[lacking > 0].sum() > e:
        return None
    edits, end = align(points(raw), points(near), low - lo, width)
    if edits > e:
        return None
    end += lo
    _, back = align(points(raw)[::-1], points(text[max(0, end - m - 2 * e - 1) : end])[::-1], -e, 2 * e + 1)
    return max(0, end - back), end, edits


def align_run(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """align() for each end at once: of each diagonal from low on, the least edits of the item against a stretch that ends on it, and where the stretch starts."""
    far = np.int32(1 << 20)
    padded = np.full(width + len(item) + 1, 0, np.int32)
    lo, hi = max(0, low), min(len(text), low + width + len(item))
    if hi > lo:
        padded[lo - low : hi - low] = text[lo:hi].astype(np.int32) + 1
    steps = np.arange(width, dtype=np.int32)
    row = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, far).astype(np.int32) - steps
    start = steps + low
    for i, c in enumerate(item.astype(np.int32) + 1):
        best, origin = row + (padded[i : i + width] != c), start.copy()
        skips = row[1:] + 2 < best[:-1]
        best[:-1][skips], origin[:-1][skips] = row[1:][skips] + 2, start[1:][skips]
        first, last = -(i + 1 + low), len(text) - (i + 1 + low)
        if first > 0:
            best[:first] = far
        if last < width - 1:
            best[max(0, last + 1) :] = far
        row = np.minimum.accumulate(best)
        start = origin[np.maximum.accumulate(np.where(best == row, steps, 0))]
    end = steps + low + len(item)
    return np.where((end >= 0) & (end <= len(text)), row + steps, far), start


def verify_run(index: Index, item: int, text: str, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the item in each of the neighbouring bands first to last, where it is within its budget.

    The bands overlap, so that one alignment of all their diagonals takes a fraction of
    what one for each would: a text that repeats itself has such runs without end.
    """
    e, m = int(index.edits[item]), len(index.items[item])
    w, raw = e + 1, points(index.items[item])
    many = max(1, WIDE // w)
    for b0 in range(first, last + 1, many):
        b1 = min(last, b0 + many - 1)
        low, width = b0 * w - e, (b1 - b0 + 2) * w + 2 * e
        lo = max(0, low)
        edits, start = align_run(raw, points(text[lo : max(lo, low + width + m)]), low - lo, width)
        for k in range(b1 - b0 + 1):
            mine = edits[k * w : k * w + 2 * w + 2 * e]
            at = int(mine.argmin())
            if mine[at] <= e:
                yield lo + max(0, int(start[k * w + at])), low + k * w + at + m, int(mine[at])


def candidates(index: Index, raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Columns (text, item, band) of bands with as many of an item's grams as its budget leaves it; texts begin at `starts` of raw.

    Bands hold two strips of e + 1 diagonals and overlap by one, so every strip of e + 1
    lies in one. A gram of the item counts once in a band, however often the text
    repeats it. Texts are looked at in stretches, each longer than its successor's
    start by any item, so memory holds whatever they repeat.
    """
    reach = max(map(len, index.items), default=0) * 2 + Q
    for begin in range(0, len(raw), STRETCH):
        code = grams(raw[begin : begin + STRETCH + reach + Q - 1])
        at = np.flatnonzero(index.table[code >> np.uint64(64 - FILTER_BITS)])
        left = np.searchsorted(index.keys, code[at], "left")
        n = np.searchsorted(index.keys, code[at], "right") - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        if not len(at):
            continue
        # Inside a run of one character, places a strip apart meet every band that all its places do.
        same = np.zeros(len(code), bool)
        same[1:-1] = (code[1:-1] == code[:-2]) & (code[1:-1] == code[2:])
        keep = ~(same[at] & (n > OFTEN) & (at % index.step[left] != 0))
        at, left, n = at[keep], left[keep], n[keep]
        doc = np.searchsorted(starts, at + begin, "right") - 1
        found, total = [], np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(PAIRS, int(total[-1]), PAIRS), "right"), len(n)))
        for x, y in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            k = n[x:y]
            entry = np.repeat(left[x:y] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            item, d = index.item[entry], np.repeat(doc[x:y], k)
            band = (np.repeat(at[x:y], k) + begin - starts[d] - index.place[entry]) // (index.edits[item] + 1)
            hits = np.stack([d, item, band, index.place[entry]])
            found.append(_distinct(hits)[0] if len(cuts) > 1 else hits)
        hits = np.concatenate(found, axis=1)
        pair = (hits[0] - hits[0].min()) * len(index.items) + hits[1]
        if pair.max() < 1 << 24:  # most pairs have too few grams in all their bands; else the same is found out band by band
            hits = hits[:, np.bincount(pair)[pair] >= index.need[hits[1]]]
        if hits.size:
            before = hits.copy()
            before[2] -= 1  # a band holds its own strip and the next one's
            bands, count = _distinct(_distinct(np.concatenate([hits, before], axis=1))[0][:3])
            yield bands[:, count >= index.need[bands[1]]]


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of a table of integers, and how often each occurs."""
    if not columns.size:
        return columns, np.zeros(0, np.int64)
    low = columns.min(axis=1)
    span = [int(s) for s in columns.max(axis=1) - low + 1]
    if math.prod(span) >= 1 << 62:
        return np.unique(columns, axis=1, return_counts=True)
    key = np.zeros(columns.shape[1], np.int64)
    for row, first, size in zip(columns, low, span, strict=True):
        key *= size
        key += row - first
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count, key = np.diff(np.append(first, len(key))), key[first]
    out = np.empty((len(columns), len(key)), np.int64)
    for k in range(len(columns) - 1, 0, -1):
        key, rest = np.divmod(key, span[k])
        out[k] = rest + low[k]
    out[0] = key + low[0]
    return out, count


def scan(index: Index, texts: list[str], first_only: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of all matches, or of one for each text that has any."""
    gap = np.zeros(Q, np.uint8)
    starts = np.cumsum([0, *(len(t) + Q for t in texts)])
    raw = np.concatenate([p for t in texts for p in (bytes_of(t), gap)] or [gap])
    seen, matched = set(), set()
    for found in candidates(index, raw, starts):
        bands = found[:, np.lexsort(found[::-1])]
        breaks = np.flatnonzero((np.diff(bands[:2], axis=1) != 0).any(axis=0) | (np.diff(bands[2]) != 1)) + 1
        for run in np.split(bands, breaks, axis=1):
            if not run.size:
                continue
            d, i = int(run[0, 0]), int(run[1, 0])
            if first_only and d in matched:
                continue
            if run.shape[1] >= RUN:
                matches = verify_run(index, i, texts[d], int(run[2, 0]), int(run[2, -1]))
            else:
                mine = [b for b in run[2].tolist() if (d, i, b) not in seen]
                seen.update((d, i, b) for b in mine)
                matches = filter(None, (verify(index, i, texts[d], b) for b in mine))
            for got in matches:
                if (d, i, -1, *got[:2]) not in seen:
                    seen.add((d, i, -1, *got[:2]))
                    matched.add(d)
                    yield d, i, *got
                    if first_only:
                        break
    for d, text in enumerate(texts if index.short else []):
        plain = fold(text)
        for i in index.short:
            k = -1
            while not (first_only and d in matched) and (k := plain.find(index.items[i], k + 1)) >= 0:
                matched.add(d)
                yield d, i, k, k + len(index.items[i]), 0


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A row for each stretch of a text within an item's edit budget: doc_id, item_id, start, end (code points), edits.

    Case of A-Z and kind of white space don't count; edits are counted in characters.
    By the q-gram lemma a stretch within e edits of an item of m characters shares at
    least m - Q + 1 - Q e of its grams with it on a strip of e + 1 diagonals; texts are
    scanned for such strips, and only these are aligned. Items shorter than Q are looked
    up as they are. The benchmark's size is looked at first: each pass carries at most
    pass_bytes of it, as plain text; a larger one takes several passes over the
    documents, each finished before the next one's items are fetched.

    Null and empty texts match nothing, null and empty items are none; a null id stays
    null; repeated rows give repeated matches, equal items a match each; empty tables
    give no rows. Very long and repetitive texts take memory in proportion to their
    length. Other columns are not read.
    """
    plain = X.texts(docs, id_col, text_col)
    items, passes = _passes(benchmark, pass_bytes)
    if passes == 1:
        return plain.mapInArrow(_scanner(_part(items, 1, 0)), SCHEMA)
    out = None
    for k in range(passes):
        part = storage.stored(plain.mapInArrow(_scanner(_part(items, passes, k)), SCHEMA))
        out = part if out is None else out.unionByName(part)
    return out


def _passes(benchmark: DataFrame, pass_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return items, max(1, math.ceil(X.sizes(items) / pass_bytes))


def _part(items: DataFrame, passes: int, k: int) -> list[tuple[int | None, str]]:
    """The items of one pass, which are of a bounded size."""
    chosen = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
    return [(r[0], r[1]) for r in chosen.collect()]


def _scanner(items: list[tuple[int | None, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(items)
        for batch in batches:
            rows = [(batch.column(0)[d].as_py(), index.ids[i], start, end, edits) for d, i, start, end, edits in scan(index, pc.fill_null(batch.column(1), "").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "start", "end", "edits"])
        X.settle()

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents, all columns, in whose text no benchmark item is found. Each row is judged by itself, where it lies.

    A null or empty text stays; rows without an id and repeated rows are judged like
    any other; other columns may have any name; an empty table gives no rows, an empty
    benchmark takes none away.
    """
    X.texts(docs, "doc_id", "text")  # bounds the batches
    items, passes = _passes(benchmark, pass_bytes)
    out = docs
    for k in range(passes):
        out = out.mapInArrow(_filter(_part(items, passes, k), docs.columns.index("text")), docs.schema)
        out = out if passes == 1 else storage.stored(out)
    return out


def _filter(items: list[tuple[int | None, str]], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(items)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, *_ in scan(index, pc.fill_null(batch.column(place), "").to_pylist(), first_only=True)]] = False
            yield batch.filter(pa.array(keep))
        X.settle()

    return run
