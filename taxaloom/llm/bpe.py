"""Byte-level BPE encoding and decoding through a distinct-word table."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import exchange as X

#: The code points with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SCHEMA = "doc_id long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def word_splitter(added: list[str]) -> re.Pattern:
    """Splits a text where the byte-level pre-tokenizer surely does.

    It cuts at white space, but for one space that it hands to the word behind it;
    of a longer run the last character stands alone. Added tokens stand alone too,
    and the text before one ends there. The pieces of a text, joined, are the text.
    """
    word, white = f"[^{WHITE}]", f"[{WHITE}]"
    if not added:
        return re.compile(f" ?{word}+|{white}+(?!{word})|{white}+")
    special = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
    inner = f"(?:(?!{special}){word})"
    return re.compile(f"{special}| ?{inner}+|{white}+(?={special})|{white}+(?!{word})|{white}+")


def read_vocabulary(path: str) -> tuple[list[str], list[bytes]]:
    """The added tokens' texts, and each id's bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    pieces = {i: bytes(byte_of[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    added = {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
    pieces |= {i: s.encode() for i, s in added.items()}
    return list(added.values()), [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def _split(table: pa.Table, added: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The block's distinct words, each position's word, and how many positions each document has.

    A text may be cut before every space, as the pre-tokenizer cuts there too and then
    sees the same on both sides, unless it has an added token or a space with white
    space before it and white space or the end behind; such texts go through the
    splitter.
    """
    text = pc.fill_null(table.column("text"), "").combine_chunks()
    odd = pc.match_substring_regex(text, f"[{WHITE}] (?:[{WHITE}]|$)")
    for token in added:
        odd = pc.or_(odd, pc.match_substring(text, token))
    odd = odd.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(text.filter(pa.array(~odd)), " ")
    parts, offsets = pc.list_flatten(lists).dictionary_encode(), lists.offsets.to_numpy()
    first = np.zeros(len(parts), bool)
    first[offsets[:-1] - offsets[0]] = True
    code = parts.indices.to_numpy().astype(np.int64) * 2 + ~first
    blank = pc.index(parts.dictionary, "").as_py()
    kept = code != 2 * blank
    code = code[kept]
    n_even = np.add.reduceat(kept, offsets[:-1] - offsets[0]) if len(lists) else np.zeros(0, np.int64)
    seen = np.flatnonzero(np.bincount(code, minlength=2 * len(parts.dictionary)))
    bare, spaced = seen[seen % 2 == 0], seen[seen % 2 == 1]
    number = np.empty(2 * len(parts.dictionary), np.int64)
    number[bare], number[spaced] = np.arange(len(bare)), len(bare) + np.arange(len(spaced))
    words = [parts.dictionary.take(pa.array(bare // 2)), pc.binary_join_element_wise(" ", parts.dictionary.take(pa.array(spaced // 2)), "")]
    splitter = word_splitter(added)
    found = [splitter.findall(t) for t in text.filter(pa.array(odd)).to_pylist()]
    rest = pa.array(list(itertools.chain.from_iterable(found)), pa.string())
    both = pa.concat_arrays([*words, rest]).dictionary_encode()
    codes, n_seen = both.indices.to_numpy(), len(seen)
    per_doc = np.zeros(len(text), np.int64)
    per_doc[~odd], per_doc[odd] = n_even, list(map(len, found))
    place, from_odd = np.empty(int(per_doc.sum()), np.int64), np.repeat(odd, per_doc)
    place[~from_odd], place[from_odd] = codes[:n_seen][number[code]], codes[n_seen:]
    return both.dictionary, place, per_doc


def _word_keys(words: pa.Array) -> np.ndarray:
    import pandas as pd

    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = X.BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """Token ids of every text, and the text that the ids decode to, as doc_id, ids array<int>, decoded binary (UTF-8); or only their digests().

    Words are split in Spark; each distinct word meets its kind from all blocks in
    one task, is encoded once, and its ids go back to the blocks that have it, which
    put them in place by position. Ids become text through a join with the table of
    the vocabulary's pieces, which is bounded by the vocabulary's size. The file at
    tokenizer_path is read where the tasks run, so every machine needs it.

    A null text counts as empty: no ids, empty text. A repeated row gives a repeated
    result, a null id stays null, an empty table gives no rows. Only the two named
    columns are read; other columns may have any name.
    """
    docs = X.texts(docs, id_col, text_col)
    buckets = X.buckets_for(docs, X.sizes(docs))
    held: dict = {}  # what a task has read of the tokenizer's file, for its further blocks

    def vocabulary() -> tuple[list[str], pa.Array]:
        if "vocabulary" not in held:
            added, pieces = read_vocabulary(tokenizer_path)
            held["vocabulary"] = added, pa.array(pieces, pa.binary())
        return held["vocabulary"]

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        words = _split(table, vocabulary()[0])[0]
        keys = _word_keys(words)
        order = np.argsort(keys, kind="stable")
        edges = X.bucket_edges(keys[order], buckets)
        for b in np.flatnonzero(np.diff(edges)):
            yield int(b), X.send_words(words.take(pa.array(order[edges[b] : edges[b + 1]])))

    def reply(payloads: list[bytes]) -> list[bytes]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if "words" not in held:
            held["words"] = WordTable(tokenizer_path)
        sent = [X.read_words(p) for p in payloads]
        table = pa.concat_arrays(sent).dictionary_encode()
        encoded = [held["words"].encode(table.dictionary.slice(at, 20_000).to_pylist()) for at in range(0, len(table.dictionary), 20_000)]
        counts = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in encoded)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(f for _, f in encoded)])
        del encoded
        out, at, codes = [], 0, table.indices.to_numpy()
        for words in sent:
            mine = codes[at : at + len(words)]
            at += len(words)
            out.append(X.join_parts([X.send_values(counts[mine]), X.send_values(_gather(flat, counts, mine))]))
        return out

    def done(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        added, piece_table = vocabulary()
        words, place, per_doc = _split(table, added)
        order = np.argsort(_word_keys(words), kind="stable")
        parts = [X.split_parts(got[b]) for b in sorted(got)]
        counts = np.concatenate([X.read_values(c).astype(np.int64) for c, _ in parts]) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([X.read_values(f).astype(np.int32) for _, f in parts]) if parts else np.zeros(0, np.int32)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[place]
        ids = _gather(flat, counts, place)
        ends = np.concatenate([[0], np.cumsum(counts[place])])[np.concatenate([[0], np.cumsum(per_doc)])]
        decoded = []
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            raw = piece_table.take(pa.array(ids[x:y]))
            n = int(pc.sum(pc.binary_length(raw)).as_py() or 0)
            start = int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]) if y > x else 0
            body = raw.buffers()[2].slice(start, n).to_pybytes() if n else b""
            decoded.append(body.decode("utf-8", "replace").encode())
        if digest:
            return pa.table(_digested(table.column("doc_id").combine_chunks(), ids, ends, decoded))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pa.table({"doc_id": table.column("doc_id"), "ids": lists, "decoded": pa.array(decoded, pa.binary())})

    answers = X.answer(X.requests(docs, emit, block_bytes), reply)
    return X.finish(X.states(docs, block_bytes), answers, done, DIGESTS if digest else SCHEMA)


class WordTable:
    """The ids of the distinct words that a task has met, each encoded once while the table holds it.

    Words are encoded many to a call with an added token between them, which the
    tokenizer cuts out before anything else, so that each stands as if alone. A table
    that has grown beyond `most` words is begun anew.
    """

    GROUP = 64

    def __init__(self, path: str, most: int = 1 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.added = Tokenizer.from_file(path), most, read_vocabulary(path)[0]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = [t for t in self.tokenizer.get_added_tokens_decoder().items() if not (t[1].lstrip or t[1].rstrip or t[1].single_word)]
        self.between = (plain[0][0], plain[0][1].content) if plain else None
        self.clear()

    def clear(self) -> None:
        self.words, self.counts, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum()))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in a row."""
        if self.between is None:
            return self._alone(words)
        id_between, text = self.between
        groups = [text.join(words[at : at + self.GROUP]) + text for at in range(0, len(words), self.GROUP)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(ids == id_between)
        if len(ends) != len(words):  # a word holds the token itself
            return self._alone(words)
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends)

    def ids(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of the texts of a block in a row, and where each text ends."""
        words, place, per_doc = _split(table, self.added)
        if len(self.words) > self.most:
            self.clear()
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            counts, flat = self.encode(fresh.to_pylist())
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
        place = at[place]
        flat = _gather(self.flat, self.counts, place)
        return flat, np.concatenate([[0], np.cumsum(self.counts[place])])[np.cumsum(per_doc)].astype(np.int64)


def _gather(flat: np.ndarray, counts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rows at these places of a ragged table, in a row."""
    starts, n = (np.cumsum(counts) - counts)[place], counts[place]
    return flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(place) else flat[:0]


def _digested(doc_id: pa.Array, ids: np.ndarray, ends: np.ndarray, decoded: Iterable[bytes]) -> dict[str, pa.Array]:
    import hashlib

    hashes = [hashlib.sha256(ids[x:y].astype("<u4").tobytes()).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
    text = [hashlib.sha256(v).hexdigest() for v in decoded]
    return {"doc_id": doc_id, "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(text, pa.string())}


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids (little-endian, 32 bits) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            yield pa.RecordBatch.from_pydict(_digested(b.column("doc_id"), ids.values.to_numpy(), ids.offsets.to_numpy(), (v.as_py() for v in b.column("decoded"))))
        X.settle()

    return encoded.mapInArrow(run, DIGESTS)
