"""Block exchange: one round trip between documents and a table keyed by something inside them.

Several operators need a corpus-wide fact about every distinct word, n-gram or
window of a text (its id, its count, whether it starts earlier elsewhere). A row
for each position would shuffle many times the input. Here an input partition is
cut into blocks of a bounded number of text bytes. A block sends each distinct
key once, packed by key range ("bucket"); the bucket's task joins what all blocks
sent and answers each block; the block's own texts, compressed, meet the answers
in one more shuffle. No key has more rows than there are blocks, so a word that
fills a third of the corpus is no hot key.

Blocks are numbered by partition and place in it. The input must therefore be
read alike each time: a file scan is, and so is a checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a block. A task holds a few dozen times this much.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to Python, where the session names no bound.
BATCH_BYTES = 1 << 20
#: Text bytes for each bucket of keys.
BUCKET_BYTES = 16 << 20

MESSAGE = "bucket int, block long, payload binary"
ANSWER = "block long, bucket int, payload binary"
STATE = "block long, payload binary"


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed bytes; the planes of equal significance lie together."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 values, as differences."""
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same values in the smallest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def join_parts(parts: list[bytes]) -> bytes:
    """Byte strings in one, each with its length."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def split_parts(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    ends = np.cumsum([4 * (n + 1), *np.frombuffer(b, "<u4", n, 4)])
    return [b[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def send_values(a: np.ndarray) -> bytes:
    small = narrow(a)
    return join_parts([small.dtype.str.encode(), squeeze(small)])


def read_values(b: bytes) -> np.ndarray:
    kind, body = split_parts(b)
    return unsqueeze(body, np.dtype(kind.decode()))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values over the whole range."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the ascending, evenly spread keys begins; the last is the end."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """The partition's (id, text) rows as numbered blocks. A text over the bound is a block of its own size."""
    from pyspark import TaskContext

    block, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for k, n in enumerate(lengths):
            if size and size + n > block_bytes:
                held.append(batch.slice(at, k - at))
                yield block, pa.Table.from_batches(held)
                block, held, size, at = block + 1, [], 0, k
            size += int(n)
        held.append(batch.slice(at))
    if held:
        yield block, pa.Table.from_batches(held)


def pack(table: pa.Table, level: int = 6) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def send_words(words: pa.Array) -> bytes:
    """Strings as their lengths and their bytes in a row. The array must start its buffer, as one from take() does."""
    body = words.buffers()[2]
    return join_parts([send_values(pc.binary_length(words).to_numpy().astype(np.int64)), zstandard.ZstdCompressor(level=3).compress(body.to_pybytes() if body else b"")])


def read_words(b: bytes) -> pa.Array:
    lengths, body = split_parts(b)
    offsets = np.concatenate([[0], np.cumsum(read_values(lengths), dtype=np.int32)]).astype(np.int32)
    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))


def sizes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def buckets_for(docs: DataFrame, n_bytes: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BUCKET_BYTES))


def settle() -> None:
    """Gives memory that a worker no longer uses back to the machine; the workers stay, idle, beside those of later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def requests(docs: DataFrame, emit: Callable[[pa.Table], Iterator[tuple[int, bytes]]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What emit says of each block, as (bucket, block, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in cut(batches, block_bytes):
            said = list(emit(table))
            if said:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in said], pa.int32()), pa.array([block] * len(said), pa.int64()), pa.array([p for _, p in said], pa.binary())], ["bucket", "block", "payload"])
            del said, table
            settle()

    return docs.mapInArrow(run, MESSAGE)


def answer(messages: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """reply gets what all blocks sent to one bucket and has an answer for each, in order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out = reply(table.column("payload").to_pylist())
        settle()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, ANSWER)


def states(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each block's (id, text) rows, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in cut(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(table)], pa.binary())], ["block", "payload"])

    return docs.mapInArrow(run, STATE)


def finish(state: DataFrame, answers: DataFrame, done: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """done gets a block's rows and its answers by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("an answer for a block that the second scan did not make: the input is not read alike each time")
        got = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        out = done(unpack(left.column("payload")[0].as_py()), got)
        settle()
        return out

    return state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def bound_batches(df: DataFrame) -> None:
    """Sets a bound on the bytes of Arrow batches where the session names none."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that blocks carry; other columns, whatever their names, stay behind."""
    bound_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
