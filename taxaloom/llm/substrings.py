"""Substring dedup: seed and extend over word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import storage

#: Words in the shortest repeat, and in a seed.
WINDOW, SEED = 20, 8
BASE = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id long, text string, n_words long, n_removed long, repeats array<struct<start:int,end:int>>"


class Words:
    """A block's documents in order of id, their words in a row, and hashes of runs of words."""

    def __init__(self, table: pa.Table) -> None:
        import pandas as pd

        ids = pc.fill_null(table.column("doc_id"), np.iinfo(np.int64).max).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.doc_ids = ids[order], table.column("doc_id").take(pa.array(order)).combine_chunks()
        lists = pc.ascii_split_whitespace(pc.fill_null(table.column("text"), "").combine_chunks().take(pa.array(order)))
        flat, offsets = pc.list_flatten(lists), lists.offsets.to_numpy()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        self.words = flat.filter(pa.array(real))
        self.ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]  # of the documents, with a leading 0
        coded = self.words.dictionary_encode()
        hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
        self.hashes = X.mix(hashes)[coded.indices.to_numpy()]
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.ends))

    def runs(self, length: int, salt: int = 0) -> np.ndarray:
        """A hash of the words from each place on, `length` of them; places too near the end have none."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(length):
            out = out * BASE + (self.hashes[j : j + n] ^ np.uint64(salt))
        return X.mix(out)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of one document starts, and where its seed does: at the least of its winnowed runs."""
        seeds = self.runs(SEED)
        span = WINDOW - SEED + 1
        if len(seeds) < span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.arange(len(seeds) - span + 1)
        starts = starts[self.doc[starts] == self.doc[starts + WINDOW - 1]]
        view = np.lib.stride_tricks.sliding_window_view(seeds, span)
        at = np.concatenate([view[starts[k : k + 65_536]].argmin(axis=1) for k in range(0, len(starts), 65_536)] or [np.zeros(0, np.int64)])
        return starts, starts + at

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, distinct seed hashes, how often each is an anchor here, and each window's seed among them."""
        starts, at = self.windows()
        places, which = np.unique(at, return_inverse=True)
        keys, of_place, counts = np.unique(self.runs(SEED)[places], return_inverse=True, return_counts=True)
        return starts, keys, counts, of_place[which] if len(starts) else which, places

    def extended(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows around repeated seeds: starts, distinct keys, their checks, first places and each window's key."""
        starts, _, _, of_window, _ = self.seeds()
        starts = starts[repeated[of_window]] if len(starts) else starts
        every, check = self.runs(WINDOW), self.runs(WINDOW, 0x5851F42D)
        keys, first, place = np.unique(every[starts] if len(starts) else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        return starts, keys, (check[starts[first]] >> np.uint64(32)).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32), starts[first] if len(starts) else first, place

    def result(self, removed: np.ndarray) -> pa.Table:
        """The documents without the removed words."""
        kept = self.words.filter(pa.array(~removed))
        n_kept = np.concatenate([[0], np.cumsum(~removed)])[self.ends]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(n_kept, pa.int32()), kept), " ")
        n_words = np.diff(self.ends)
        # A stretch never runs over a document's end: it begins anew there.
        begins = removed & ~np.concatenate([[False], removed[:-1]])
        begins[self.ends[:-1][n_words > 0]] |= removed[self.ends[:-1][n_words > 0]]
        finish = removed & ~np.concatenate([removed[1:], [False]])
        finish[self.ends[1:][n_words > 0] - 1] |= removed[self.ends[1:][n_words > 0] - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        base = self.ends[:-1][self.doc[begin]] if len(begin) else begin
        offsets = np.searchsorted(begin, self.ends)
        spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base, pa.int32())], ["start", "end"])
        return pa.table(
            {
                "doc_id": self.doc_ids,
                "text": text,
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_words - np.diff(n_kept), pa.int64()),
                "repeats": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
            }
        )



def _bits(parts: list[bytes], keys: np.ndarray, buckets: int) -> np.ndarray:
    """The flags that buckets sent for a block's ascending keys."""
    edges = X.bucket_edges(keys, buckets)
    sizes = np.diff(edges)
    given = [np.unpackbits(np.frombuffer(p, np.uint8), count=int(n)) for p, n in zip(parts, sizes[sizes > 0], strict=True)]
    return np.concatenate(given).astype(bool) if given else np.zeros(0, bool)


def _in_order(got: dict[int, bytes]) -> list[bytes]:
    return [got[b] for b in sorted(got)]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """Every text without the words that repeat an earlier stretch of WINDOW or more words.

    Words lie between ASCII white space. Columns: doc_id, text (kept words joined by
    one space), n_words, n_removed, repeats (the maximal removed stretches, as word
    numbers, end exclusive). A word goes if a window of WINDOW words of its document
    covers it whose words also start earlier: in a smaller doc_id, or further left.

    Each window is anchored at the least of its SEED-word runs (winnowing), so equal
    windows have equal seeds at the same distance. Seeds that occur once in the corpus
    end there. Around the others the match is extended to both sides, to every window
    that the seed anchors; for each window's words the corpus keeps the first
    occurrence only, never the pairs. 96 bits of hashes stand for a window's words.

    Null texts count as empty; a null id comes last in the order; rows with equal ids
    are ordered by their place in the input; an empty table gives no rows. Only the
    two named columns are read.
    """
    docs = X.texts(docs, id_col, text_col)
    buckets = X.buckets_for(docs, X.sizes(docs))

    def emit_seeds(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        keys = Words(table).seeds()[1]
        edges = X.bucket_edges(keys, buckets)
        for b in np.flatnonzero(np.diff(edges)):
            yield int(b), X.squeeze_sorted(keys[edges[b] : edges[b + 1]])

    def reply_seeds(payloads: list[bytes]) -> list[bytes]:
        sent = [X.unsqueeze_sorted(p) for p in payloads]
        _, place, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *map(len, sent)])
        return [np.packbits(counts[place[x:y]] > 1).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def repeated(words: Words, got: list[bytes]) -> np.ndarray:
        _, keys, counts, _, _ = words.seeds()
        return (counts > 1) | _bits(got, keys, buckets)

    def emit_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words = Words(X.unpack(left.column("payload")[0].as_py()))
        _, keys, check, first, _ = words.extended(repeated(words, _in_order(dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True)))))
        edges = X.bucket_edges(keys, buckets)
        of = words.ids[words.doc[first]] if len(first) else np.zeros(0, np.int64)
        out = [(int(b), X.join_parts([X.squeeze_sorted(keys[x:y]), X.squeeze(check[x:y]), X.squeeze(of[x:y])])) for b, x, y in ((b, edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges)))]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    def reply_windows(payloads: list[bytes]) -> list[bytes]:
        sent = [X.split_parts(p) for p in payloads]
        keys = np.concatenate([X.unsqueeze_sorted(s[0]) for s in sent])
        check = np.concatenate([X.unsqueeze(s[1], np.uint32) for s in sent])
        ids = np.concatenate([X.unsqueeze(s[2], np.int64) for s in sent])
        cuts = np.cumsum([0, *(len(X.unsqueeze(s[1], np.uint32)) for s in sent)])
        order = np.lexsort((ids, check, keys))  # stable: equal ids stay in the order of blocks
        k, c = keys[order], check[order]
        later = np.zeros(len(order), bool)
        later[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        return [np.packbits(later[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def done(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        words = Words(table)
        about_seeds = {-1 - b: p for b, p in got.items() if b < 0}
        starts, keys, _, first, place = words.extended(repeated(words, _in_order(about_seeds)))
        later = _bits(_in_order({b: p for b, p in got.items() if b >= 0}), keys, buckets)
        gone = starts[later[place] | (starts != first[place])] if len(starts) else starts
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        removed = np.cumsum(edge)[:-1] > 0
        return words.result(removed)

    state = X.states(docs, block_bytes)
    about_seeds = storage.stored(X.answer(X.requests(docs, emit_seeds, block_bytes), reply_seeds))
    messages = state.groupBy("block").cogroup(about_seeds.groupBy("block")).applyInArrow(emit_windows, X.MESSAGE)
    both = X.answer(messages, reply_windows).unionByName(about_seeds.withColumn("bucket", -1 - F.col("bucket")))
    return X.finish(state, both, done, SCHEMA)
