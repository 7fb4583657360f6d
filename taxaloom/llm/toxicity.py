"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import storage

#: A label is held out when the CRC-32 of the id as text leaves this.
FOLDS, HELD_OUT = 4, 2
#: Labelled documents of each class that the model may be fitted on, by hash order of the id, and UTF-8 bytes of their texts.
#: A text that would go over the bytes is passed by, whatever its class; none is cut.
SAMPLE, SAMPLE_BYTES = 1500, 8 << 20
THRESHOLD = 0.3
#: Marginals below this count as nothing in a document's measures.
DOUBT = 0.2
#: Chains are sentences. Their words are gone through one by one in stretches of this many; the stretches of a longer
#: sentence meet in the matrices that carry the field over each of them.
STRETCH = 128
PREFIXES = (4, 5)
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…¿¡–—"
#: Evidence (a likelihood ratio statistic) that makes a feature's words toxic in toxic documents.
EVIDENCE = 25.0
ROUNDS, STEP, RIDGE = 80, 0.2, 1e-3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass
class Model:
    keys: np.ndarray  # of features, ascending
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # exp of the weights of (from, to)
    scale: np.ndarray  # of the document's measures, the last being constant


def _plain(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), EDGE)


def _features(words: pa.Array) -> np.ndarray:
    """A row for each distinct word: keys of the word itself and of its beginnings."""
    import pandas as pd

    plain = _plain(words)
    cols = []
    for k, part in enumerate([plain, *(pc.utf8_slice_codeunits(plain, 0, n) for n in PREFIXES)]):
        coded = part.dictionary_encode()
        h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
        cols.append(X.mix(h + np.uint64(k))[coded.indices.to_numpy()])
    return np.stack(cols, axis=1)


class Chains:
    """The words of many texts in a row, cut into chains."""

    def __init__(self, text: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        flat, offsets = pc.list_flatten(lists), lists.offsets.to_numpy()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.distinct, self.word = coded.dictionary, coded.indices.to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
        n = len(self.word)
        self.doc = np.repeat(np.arange(len(text)), np.diff(self.ends))
        stops = pc.match_substring_regex(self.distinct, "[.!?]$").to_numpy(zero_copy_only=False)
        begins = np.zeros(n, bool)
        if n:
            begins[1:] = stops[self.word[:-1]]
            begins[self.ends[:-1][np.diff(self.ends) > 0]] = True
        first = np.flatnonzero(begins)
        place = np.arange(n) - first[np.cumsum(begins) - 1] if n else np.zeros(0, np.int64)
        starts = np.flatnonzero(place % STRETCH == 0)
        lengths, number = np.diff(np.append(starts, n)), place[starts] // STRETCH
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first, self.starts, self.lengths, self.number = first, starts[order], lengths[order], number[order]
        further = np.flatnonzero(number > 0)
        further = further[np.argsort(number[further], kind="stable")]
        layers = np.split(further, np.flatnonzero(np.diff(number[further])) + 1) if len(further) else []
        #: The second, third, ... stretches of all sentences that have them, each beside the one before it.
        self.layers = [(rank[k], rank[k - 1]) for k in layers]

    def _across(self, up: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of the word before each stretch, and the odds that what follows gives to toxic at its last word."""
        enter, tail = np.full(len(self.starts), 0.5), np.ones(len(self.starts))
        if not self.layers:
            return enter, tail
        of = np.unique(np.concatenate([k for layer in self.layers for k in layer]))
        at, lengths, opens = self.starts[of], self.lengths[of], self.number[of] == 0
        carried = np.broadcast_to(np.eye(2), (len(of), 2, 2)).copy()
        for t in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, "left"))
            word = np.stack([np.ones(live), up[at[:live] + t]], axis=1)[:, None, :]
            step = (np.where(opens[:live, None, None], np.eye(2), moves) if t == 0 else moves) * word
            product = carried[:live] @ step
            carried[:live] = product / product.max(axis=(1, 2), keepdims=True)
        place = np.zeros(len(self.starts), np.int64)
        place[of] = np.arange(len(of))
        ahead, behind = np.zeros((len(of), 2)), np.ones((len(of), 2))
        ahead[opens] = carried[opens].sum(axis=1)
        for own, before in self.layers:
            v = ahead[place[before]] / ahead[place[before]].sum(axis=1, keepdims=True)
            enter[own] = v[:, 1]
            ahead[place[own]] = (v[:, None, :] @ carried[place[own]])[:, 0]
        for own, before in reversed(self.layers):
            v = (carried[place[own]] @ behind[place[own]][:, :, None])[:, :, 0]
            behind[place[before]] = v / v.max(axis=1, keepdims=True)
            tail[before] = v[:, 1] / v[:, 0]
        return enter, tail

    def marginals(self, pull: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each word, and if asked for the expected number of each move; pull is each word's log odds."""
        n = len(pull)
        up, ahead, before, after = np.exp(np.clip(pull, -30, 30)), np.empty(n), np.empty(n), np.ones(n)
        steps = [int(np.searchsorted(-self.lengths, -t, "left")) for t in range(int(self.lengths[0]) if len(self.lengths) else 0)]
        p, tail = self._across(up, moves)
        for t, live in enumerate(steps):
            at = self.starts[:live] + t
            q = p[:live]
            to1, to0 = (1 - q) * moves[0, 1] + q * moves[1, 1], (1 - q) * moves[0, 0] + q * moves[1, 0]
            if t == 0:  # no move leads to a sentence's first word
                to1, to0 = np.where(self.number == 0, 1.0, to1), np.where(self.number == 0, 1.0, to0)
            before[at] = q
            p = to1 * up[at] / (to1 * up[at] + to0)
            ahead[at] = p
        # `after` is the odds that what follows gives to toxic at this place.
        after[self.starts + self.lengths - 1] = tail
        for t in range(len(steps) - 2, -1, -1):
            live = steps[t + 1]
            at = self.starts[:live] + t
            w = up[at + 1] * after[at + 1]
            after[at] = (moves[1, 0] + moves[1, 1] * w) / (moves[0, 0] + moves[0, 1] * w)
        out = ahead * after / (ahead * after + 1 - ahead)
        counts = np.zeros((2, 2))
        if pairs:
            inner = np.ones(n, bool)
            inner[self.first] = False
            q, w = before[inner], (up * after)[inner]
            del ahead, before, after, up
            joint = np.empty((4, len(q)))  # filled and divided in place: one task holds all words
            joint[0], joint[2] = (1 - q) * moves[0, 0], q * moves[1, 0]
            joint[1], joint[3] = (1 - q) * moves[0, 1] * w, q * moves[1, 1] * w
            joint /= joint.sum(axis=0)
            counts = joint.sum(axis=1).reshape(2, 2)
        return out, counts

    def pull(self, model: Model) -> np.ndarray:
        keys = _features(self.distinct)
        place = np.minimum(np.searchsorted(model.keys, keys), max(len(model.keys) - 1, 0))
        known = model.keys[place] == keys if len(model.keys) else np.zeros(keys.shape, bool)
        return (np.where(known, model.weights[place] if len(model.weights) else 0.0, 0.0).sum(axis=1) + model.bias)[self.word]


def _label_tokens(chains: Chains, toxic: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which words are toxic, from labels of documents.

    A feature counts once for each pair of neighbours it stands between, so that
    copies of a document do not make its words look typical. Features far likelier
    in toxic documents mark their words there; a toxic document without such a word
    has its likeliest one marked.
    """
    word, n = chains.word, len(chains.word)
    left, right = np.roll(word, 1), np.roll(word, -1)
    best = np.full(len(chains.distinct), -np.inf)
    of_toxic = toxic[chains.doc]
    context = X.mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
    totals = [max(1, int((~of_toxic).sum())), max(1, int(of_toxic.sum()))]
    for col in features.T:
        keys, inverse = np.unique(col, return_inverse=True)
        token = inverse[word]
        pair = X.mix(context + token.astype(np.uint64))
        seen = []
        for side in (~of_toxic, of_toxic):
            _, first = np.unique(pair[side], return_index=True)
            seen.append(np.bincount(token[side][first], minlength=len(keys)))
        a, b = seen[1].astype(float), seen[0].astype(float)
        ea, eb = (a + b) * totals[1] / sum(totals), (a + b) * totals[0] / sum(totals)
        g = 2 * (a * np.log(np.maximum(a, 1e-9) / ea) + b * np.log(np.maximum(b, 1e-9) / eb))
        rate = (a + 0.5) / (totals[1] + 1) / ((b + 0.5) / (totals[0] + 1))
        best = np.maximum(best, np.where(rate > 10, g, 0.0)[inverse])
    strength = best[word]
    marked = of_toxic & (strength >= EVIDENCE)
    has = np.bincount(chains.doc[marked], minlength=len(toxic)) > 0
    for d in np.flatnonzero(toxic & ~has):
        x, y = chains.ends[d], chains.ends[d + 1]
        if y > x and strength[x:y].max() > 0:
            marked[x + int(strength[x:y].argmax())] = True
    return marked if n else np.zeros(0, bool)


def fit(text: pa.Array, toxic: np.ndarray) -> Model:
    """The field's weights by gradient ascent on the likelihood of the marked words, then the scale of document scores."""
    chains = Chains(text)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, np.ones((2, 2)), np.array([0.0, 0.0, 4.0 if len(toxic) and toxic.all() else -4.0]))
    if not toxic.any() or toxic.all() or not len(chains.word):
        return none
    features = _features(chains.distinct)
    y = _label_tokens(chains, toxic, features)
    keys, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    after_first = np.ones(len(y), bool)
    after_first[chains.first] = False
    at = np.flatnonzero(after_first)
    seen_moves = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2).astype(float)
    n_docs = len(toxic)
    theta = np.concatenate([np.zeros(len(keys)), [-3.0], np.zeros(4)])
    grad_sum = np.full(len(theta), 1e-8)
    rate = np.zeros(len(theta))
    for k in range(ROUNDS):
        w, bias, logs = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        m, pairs = chains.marginals((w[place].sum(axis=1) + bias)[chains.word], np.exp(logs), pairs=True)
        wrong = y - m
        by_word = np.bincount(chains.word, wrong, len(chains.distinct))
        grad = np.concatenate([np.bincount(place.ravel(), np.repeat(by_word, place.shape[1]), len(keys)), [wrong.sum()], (seen_moves - pairs).ravel()]) / n_docs - RIDGE * np.append(theta[:-5], np.zeros(5)) / n_docs
        rate = 0.9 * rate + 0.1 * grad
        grad_sum = 0.98 * grad_sum + 0.02 * grad * grad
        theta = theta + STEP * (0.97**k) * (rate / (1 - 0.9 ** (k + 1))) / np.sqrt(grad_sum / (1 - 0.98 ** (k + 1)) + 1e-16)
    used = np.abs(theta[:-5]) > 1e-3
    model = Model(keys[used], theta[:-5][used], float(theta[-5]), np.exp(theta[-4:].reshape(2, 2)), np.zeros(3))
    return _scaled(model, chains, toxic)


def _strength(chains: Chains, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Two measures of each text, and its words' marginals: the expected number of toxic words, and their evidence together."""
    m, _ = chains.marginals(chains.pull(model), model.moves)
    n = len(chains.ends) - 1
    counted = np.where(m >= DOUBT, m, 0.0)  # else the small doubts of a very long text would add up
    evidence = -np.log(np.maximum(1 - counted, 1e-6))
    return np.stack([np.log(np.bincount(chains.doc, counted, n) + 0.3), np.log(np.bincount(chains.doc, evidence, n) + 0.5), np.ones(n)], axis=1), m


def _scaled(model: Model, chains: Chains, toxic: np.ndarray) -> Model:
    """Logistic regression of the label on the two measures, by Newton's steps with a little shrinkage."""
    design = _strength(chains, model)[0]
    beta = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-1 * np.eye(3)
        beta = beta + np.linalg.solve(hessian, design.T @ (toxic - p) - 1e-1 * beta)
    model.scale = beta
    return model


def document_scores(chains: Chains, model: Model) -> tuple[np.ndarray, np.ndarray]:
    x, m = _strength(chains, model)
    return 1 / (1 + np.exp(-np.clip(x @ model.scale, -500, 500))), m


def _fitted(rows: DataFrame, sample_bytes: int) -> tuple[Model, list[int]]:
    """The model of (h, doc_id, toxic, text) rows, and how many of each class it took. One task reads them in order and holds what it takes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spent = [], [0, 0]
        for batch in batches:
            toxic, size = batch.column(2).to_numpy(), pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            for k, (t, n) in enumerate(zip(toxic, size, strict=True)):
                if spent[t] + n <= sample_bytes:
                    keep[k], spent[t] = True, spent[t] + int(n)
            held.append(batch.filter(pa.array(keep)))
        if held:
            table = pa.Table.from_batches(held).select([2, 3]).combine_chunks()
            toxic = table.column(0).to_numpy() == 1
            m = fit(table.column(1).combine_chunks(), toxic)
            parts = [m.keys, m.weights, np.array([m.bias]), m.moves.ravel(), m.scale, np.array([(~toxic).sum(), toxic.sum()], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in parts], ["keys", "weights", "bias", "moves", "scale", "taken"])
        X.settle()

    columns = ", ".join(f"{c} binary" for c in ("keys", "weights", "bias", "moves", "scale", "taken"))
    got = rows.select("h", "doc_id", "toxic", "text").repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(run, columns).collect()
    if not got:
        return fit(pa.array([], pa.string()), np.zeros(0, bool)), [0, 0]
    r = {c: np.frombuffer(bytes(got[0][c]), np.uint64 if c == "keys" else np.int64 if c == "taken" else np.float64) for c in got[0].asDict()}
    return Model(r["keys"], r["weights"], float(r["bias"][0]), r["moves"].reshape(2, 2), r["scale"]), r["taken"].tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` labelled documents and `sample_bytes` of text of each class, never the held-out ones.

    The sample is the labelled ids first in hash order. It is fitted in one task, which
    both bounds serve; no text comes to the driver. Rows whose label or id is null do
    not count; of several labels of an id the larger holds, of several texts the
    smallest. A corpus without both classes gives a model that knows nothing.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ours = known.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT) & F.col("toxic").isin(0, 1))
    with_text = ours.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    totals = {r.toxic: r["count"] for r in with_text.groupBy("toxic").count().collect()}
    picked = None
    for toxic in (0, 1):
        part = with_text.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    chosen = storage.stored(picked)  # at most 2 * sample rows of three numbers
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    model, taken = _fitted(rows, sample_bytes)
    if all(taken):  # the classes' shares in the sample are not those in the corpus
        model.scale = model.scale + np.array([0, 0, np.log(totals[1] / taken[1]) - np.log(totals[0] / taken[0])])
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), spans array<struct<start, end, p>> of toxic words (code points, end exclusive).

    Only words tell: ids, labels, sources and languages are no inputs of a score. A
    null or empty text has no toxic word and gets the score of that; a null id stays
    null; repeated rows are each scored; an empty table gives no rows. Texts of any
    length are scored whole.
    """
    plain = X.texts(docs, id_col, text_col)
    model = train(plain, labels, sample)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = Chains(batch.column(1))
            p, m = document_scores(chains, model)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            hits = np.flatnonzero(m >= 0.5)
            for d in np.unique(chains.doc[hits]):
                places = [w.span() for w in WORD.finditer(batch.column(1)[int(d)].as_py())]
                spans[d] = [{"start": places[h - chains.ends[d]][0], "end": places[h - chains.ends[d]][1], "p": float(m[h])} for h in hits[np.searchsorted(chains.doc[hits], d) : np.searchsorted(chains.doc[hits], d, "right")]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])
        X.settle()

    return plain.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose text scores below the threshold. Each row is judged by itself, where it lies.

    A null or empty text scores what no toxic word does, and stays unless the labels
    know toxic texts only; rows without an id and repeated rows are judged like any
    other; other columns may have any name; an empty table gives no rows.
    """
    model = train(X.texts(docs, "doc_id", "text"), labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = document_scores(Chains(batch.column(place)), model)
            yield batch.filter(pa.array(p < threshold))
        X.settle()

    return docs.mapInArrow(run, docs.schema)
