"""Best-fit packing of token sequences in bulk-synchronous rounds over ranges of ranks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, storage
from . import exchange as X

CAPACITY = 1024
#: Text bytes that a task encodes at once: more share a look-up of their words, and take more memory.
BLOCK_BYTES = 8 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Placements(NamedTuple):
    """Ranges of ranks of pieces of one length, by length, then first rank: `per` of them fill each sequence from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece of n tokens; of a longer document the first piece takes what is over."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, s + capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document's pieces; each is numbered (`nth`) among the pieces of its length that its task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = bpe.WordTable(tokenizer_path)
        met, task, end = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for _, table in X.cut(batches, block_bytes):
            ids, ends = words.ids(table)
            out = []
            for k, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                raw = ids[a:b].astype("<u4").tobytes() + end
                out += [(k, i, s, e - s, zlib.crc32(raw[4 * s : 4 * e])) for i, (s, e) in enumerate(cuts(int(b - a) + 1, capacity))]
            of, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*out, strict=True))
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + met[ranked]
            met += np.bincount(length, minlength=capacity + 1)
            doc_id = table.column("doc_id").combine_chunks().take(pa.array(of))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc)), pa.array([task] * len(of), pa.int32()), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            X.settle()

    return X.texts(docs, "doc_id", "text").mapInArrow(run, PIECES)


def rounds(lengths: dict[int, int], capacity: int = CAPACITY) -> Placements:
    """Best-fit decreasing over how many pieces have each length.

    Pieces and gaps are runs: ranks of one length, sequences of one gap. In a round the
    longest pieces that are left sweep the gaps upwards from their successor, the least
    gap that holds them. Of a run of gaps each takes as many as fit, as it remains the
    best fit; lower ranks go first, and where pieces run out within a run of gaps, it is
    split. Gaps are updated when the round is over; what found none opens sequences.
    A round adds at most three runs, and a sequence takes pieces of few lengths, so
    that neither runs nor placements grow with the corpus.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, how many)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        updated: list[tuple[int, int, int]] = []
        successors = [g for g in range(length, capacity + 1) if g in gaps]
        fresh = (opened, -(-left // (capacity // length)))  # as many as could be opened
        for gap, runs in [*((g, gaps.pop(g)) for g in successors), (capacity, [fresh])]:
            fit = gap // length
            for first, many in runs:
                full = min(many, left // fit)
                for at, sequences, per in ((first, full, fit), (first + full, 1, left - full * fit if full < many else 0)):
                    if per and sequences:
                        out.append((length, rank, per, at, capacity - gap))
                        updated.append((gap - per * length, at, sequences))
                        rank += per * sequences
                        left -= per * sequences
                        first, many = at + sequences, many - sequences
                if gap == capacity and runs == [fresh]:
                    opened = first
                elif many:
                    updated.append((gap, first, many))
        for gap, first, many in updated:
            if gap:
                gaps.setdefault(gap, []).append((first, many))
    rows = np.array(sorted(out), np.int64).reshape(-1, 5)
    return Placements(*rows.T)


def place(ranked: DataFrame, placements: Placements) -> DataFrame:
    """The pieces (with rank) in their sequences."""
    keys = placements.length << np.int64(48) | placements.rank
    shared = ranked.sparkSession.sparkContext.broadcast((keys, placements))  # bounded by the capacity, see rounds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, p = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << np.int64(48) | rank, "right") - 1
            within = rank - p.rank[at]
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(p.sequence[at] + within // p.per[at]), pa.array(p.offset[at] + within % p.per[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents in sequences of at most `capacity` tokens.

    A document is its token ids and the end id. Only longer ones are cut: whole
    sequences from the end, and a first piece of what is over. Pieces are sorted by
    length by counting: a task numbers its own, the tasks' counts add up to ranks.
    rounds() then decides about ranges of ranks, and each piece finds its own range.

    A null text is an empty one, one token; a null id stays null; repeated rows are
    packed each; an empty table gives no rows. Other columns are not read.
    """
    cut = storage.stored(pieces(docs, tokenizer_path, end_id, capacity))
    counts = storage.stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    ranked = cut.join(starts, ["task", "length"]).withColumn("rank", F.col("from") + F.col("nth"))
    return place(ranked, rounds(lengths, capacity))
