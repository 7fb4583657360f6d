"""Language-model scores from a weighted backoff automaton."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import storage

#: A document is kept from training when the CRC-32 of its id as text leaves 0.
FOLDS = 10
#: Added to each count of the base model.
ADDED = 0.1
#: Words of the longest context, and how much a state of each length weighs the next shorter one's opinion against its own counts.
ORDER, PRIORS = 2, (500.0, 10.0)
#: Keys of the two things that are no words: the end of a text, and the state before its first word.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PAIR, WIDER = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    """A null id counts as the empty text, and so is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's token keys in a row, each document's first place, and whether each token trains."""
    import pandas as pd

    text = pc.ascii_lower(pc.fill_null(table.column("text"), "")).combine_chunks()
    split = pc.ascii_split_whitespace(text)
    words = pc.list_flatten(split)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    held = np.concatenate([[0], np.cumsum(real)])
    offsets = split.offsets.to_numpy()
    per_doc = np.diff(held[offsets - offsets[0]])
    coded = words.filter(pa.array(real)).dictionary_encode()
    keys = X.mix(pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)) if len(coded.dictionary) else np.zeros(0, np.uint64)
    starts = np.cumsum(per_doc + 1) - (per_doc + 1)
    out = np.full(int(per_doc.sum()) + len(per_doc), END, np.uint64)
    place = np.ones(len(out), bool)
    place[starts + per_doc] = False
    out[place] = keys[coded.indices.to_numpy()]
    trains = np.array([not held_out(i) for i in table.column("doc_id").to_pylist()], bool)
    return out, starts, np.repeat(trains, per_doc + 1)


def _arcs(token: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Keys of the arcs that each token takes from states of one word and more; the start counts as a word, of which one comes before any text."""
    word = np.empty_like(token)
    word[1:] = token[:-1]
    word[starts] = START
    arcs, state = [X.mix(word * PAIR + token)], word
    for _ in range(ORDER - 1):
        older = np.empty_like(state)  # the state before, one word longer than the last one's beginning
        older[1:] = arcs[-1][:-1]
        older[starts] = START
        arcs.append(X.mix(older * PAIR + token * WIDER))
    return arcs


def _distinct(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, how often each trains here, and each position's place among them."""
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, trains, len(found)).astype(np.int64), place


def traverse(counts: list[np.ndarray], starts: np.ndarray, p_word: np.ndarray, n_docs: int, priors: tuple[float, ...]) -> np.ndarray:
    """The automaton's weight of each token, all texts left to right.

    counts: of each token by itself, then of its arcs from states of one, two and more
    words. A traversal carries its state, the longest context that training had: the
    state after a token is the longest arc that led there. A token takes the arc of the
    state where there is one; else it goes along failure arcs to shorter states, each of
    which adds its weight, down to the root's arc.
    """
    weight = np.log10(p_word)
    state = np.ones(len(weight), bool)  # whether the state of the length at hand exists before the token
    for length, prior in enumerate(priors, 1):
        before = np.empty_like(counts[0])
        before[1:] = counts[length - 1][:-1]
        before[starts] = n_docs
        if length > 1:  # a longer context than the start would be the start's own
            before[starts] = 0
        state = before > 0
        taken = counts[length] > 0
        lower = 10.0**weight
        by_arc = np.log10((counts[length] + prior * lower) / (before + prior))
        by_failure = np.log10(prior / (before + prior)) + weight
        weight = np.where(state, np.where(taken, by_arc, by_failure), weight)
    return weight


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", priors: tuple[float, ...] = PRIORS, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """Log10 probabilities of every whole text, learnt from the documents that aren't held out.

    States of the automaton are the contexts (ORDER words or fewer, with the start) and
    the root. An arc from a state h to a seen next word has weight log10((c(hw) + prior
    p(w | h')) / (c(h) + prior)), h' being h without its first word, and its failure arc,
    to h', log10(prior / (c(h) + prior)); the root's arcs have log10 p(w), p being the
    base model with its share for unknown words. A context that training never had is
    no state: the one before it was already shorter. These weights sum to one in each
    state. A text is traversed once, left to right, its end included.

    Counts come from all training documents: a block sends each distinct word and
    arc once with its own count, and gets back the corpus's. Null texts count as empty
    (one token, the end), a null id as held out; repeated rows are each scored, and each
    trains. An empty table gives no rows. Only the two named columns are read.
    """
    docs = X.texts(docs, id_col, text_col)
    buckets = X.buckets_for(docs, X.sizes(docs))

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        token, starts, trains = tokens(table)
        docs_here = int(trains[starts].sum())
        kinds = [_distinct(k, trains)[:2] for k in (token, *_arcs(token, starts))]
        cuts = [X.bucket_edges(k, buckets) for k, _ in kinds]
        for b in range(buckets):
            parts = []
            for (k, c), e in zip(kinds, cuts, strict=True):
                parts += [X.squeeze_sorted(k[e[b] : e[b + 1]]), X.send_values(c[e[b] : e[b + 1]])]
            if any(e[b] < e[b + 1] for e in cuts) or not b:
                yield b, X.join_parts([*parts, str(docs_here if not b else 0).encode()])

    def reply(payloads: list[bytes]) -> list[bytes]:
        sent = [X.split_parts(p) for p in payloads]
        out: list[list[bytes]] = [[] for _ in sent]
        facts = [sum(int(s[-1]) for s in sent)]
        for at in range(0, 2 * (ORDER + 1), 2):
            keys, counts = [X.unsqueeze_sorted(s[at]) for s in sent], [X.read_values(s[at + 1]) for s in sent]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
            facts += [int((total > 0).sum()), int(total.sum())] if not at else []
            n = 0
            for k, mine in enumerate(keys):
                out[k].append(X.send_values(total[place[n : n + len(mine)]] - counts[k]))
                n += len(mine)
            del keys, counts, every, place, total
        return [X.join_parts([*o, repr(facts).encode() if not k else b"[0, 0, 0]"]) for k, o in enumerate(out)]

    answers = storage.stored(X.answer(X.requests(docs, emit, block_bytes), reply))
    n_docs, distinct, n = _totals(answers)

    def done(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        token, starts, trains = tokens(table)
        parts = [X.split_parts(got[b]) for b in sorted(got)]
        found = []
        for at, keys in enumerate((token, *_arcs(token, starts))):
            _, here, place = _distinct(keys, trains)
            found.append((here + np.concatenate([X.read_values(p[at]).astype(np.int64) for p in parts]))[place])
        p_word = (found[0] + ADDED) / (n + ADDED * (distinct + 1))
        weight = traverse(found, starts, p_word, n_docs, priors)
        ends = np.append(starts[1:], len(token))
        ids = table.column("doc_id").to_pylist()
        sums = lambda a: np.add.reduceat(a, starts) if len(starts) else np.zeros(0, a.dtype)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": pa.array([held_out(i) for i in ids], pa.bool_()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "n_known": pa.array(sums((found[0] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([n] * len(ids), pa.int64()),
                "base_score": pa.array(sums(np.log10(p_word)), pa.float64()),
                "score": pa.array(sums(weight), pa.float64()),
            }
        )

    return X.finish(X.states(docs, block_bytes), answers, done, SCHEMA)


def _totals(answers: DataFrame) -> tuple[int, int, int]:
    """Training documents, distinct training tokens, training tokens: three numbers, summed over the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            facts = np.array([json.loads(X.split_parts(p)[-1]) for p in b.column(0).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in facts.T], ["d", "v", "n"])

    row = answers.select("payload").mapInArrow(run, "d long, v long, n long").agg(F.sum("d"), F.sum("v"), F.sum("n")).first()
    return tuple(int(x or 0) for x in row)
