"""SimHash near-duplicates by multi-index hashing; and texts of similar shingles, by SimHash and an exact prefix join for the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import graph, storage

SEGMENTS, SEGMENT_BITS = 4, 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the signed 64-bit SimHash of each whole text.

    A-Z become a-z; words lie between ASCII white space; each run of `shingle` words,
    joined by spaces, counts once for each time it occurs, by its XXH64 (seed 42). A
    text of fewer words is one shingle; a null text or one without words has
    fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in pc.ascii_lower(batch.column(1)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if not words:
                    out.append(0)
                    continue
                n = max(1, len(words) - shingle + 1)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts, ends = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1).tolist()
                joined = b" ".join(words)
                out.append(_fingerprint(np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts, ends, strict=True)), np.uint64, n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])
        X.settle()

    return X.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def _segment(k: int) -> Column:
    return F.shiftrightunsigned("fp", k * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _without(fp: Column, k: int) -> Column:
    """The fingerprint with segment k cleared."""
    mask = ~(((1 << SEGMENT_BITS) - 1) << (k * SEGMENT_BITS)) & ((1 << 64) - 1)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) with one or two differing bits, each once or twice.

    Two differing bits touch at most two of the four 16-bit segments. If they lie in
    one, the other three are equal: the table without that segment finds the pair. If
    they lie in two, then in the table without the later of them the pair agrees but
    for one bit of the earlier, which one side has set: that side looks up the ball
    of keys with one of its set bits cleared. Keys have 48 bits, so that a bucket
    holds at most the values of one segment however many documents are near copies.
    """
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), _without(F.col("fp"), t).alias("key")) for t in range(SEGMENTS)])).alias("x")).select("fp", "x.*")
    bits = F.array(*[F.lit((1 << p) - (1 << 64) if p == 63 else 1 << p) for p in range((SEGMENTS - 1) * SEGMENT_BITS)])
    ball = (
        fps.select("fp", F.explode(F.filter(bits, lambda b: F.col("fp").bitwiseAND(b) != 0)).alias("bit"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("near"), "bit")
        .select("fp", F.explode(F.array(*[F.when(F.shiftrightunsigned("bit", t * SEGMENT_BITS) == 0, F.struct(F.lit(t).cast("byte").alias("t"), _without(F.col("near"), t).alias("key"))) for t in range(1, SEGMENTS)])).alias("x"))
        .where("x is not null")
        .select("fp", "x.*")
    )
    probes = table.unionByName(ball).withColumnRenamed("fp", "a")
    return probes.join(table.withColumnRenamed("fp", "b"), ["t", "key"]).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, 2)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the smallest doc_id reachable by links of two or fewer differing bits.

    Copies of a fingerprint are one vertex. Rows come back as often as they went in;
    a null id keeps its row and is never a component's name unless it has nothing
    else. Empty texts share fingerprint 0 and link like any other. An empty table
    gives no rows; other columns are not read.
    """
    prints = storage.stored(fingerprints(docs, shingle, id_col, text_col))
    vertices = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"))
    found = graph.components(links(vertices.select("fp")))
    named = vertices.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(smallest, "component").select(F.col("fp").alias("fingerprint"), "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


SIMILARITY = 0.8
#: One text in so many shows which shingles are common, and so many of them at most go to the tasks. Both only choose an order: any finds all pairs.
SAMPLE, COMMON = 16, 200_000


def _shingles(text: pa.Scalar, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each distinct shingle of a lower-cased text, ascending."""
    import xxhash

    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1).tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts, ends, strict=True)), np.uint64, n))


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of the texts have, ascending, and how many have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(t, shingle) for t in pc.ascii_lower(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["token"])
        X.settle()

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    top = sample.mapInArrow(run, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    tokens, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    by = np.argsort(tokens)
    return tokens[by], counts[by].astype(np.int32)


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, size (its number of distinct shingles), and its first shingles in an order that all texts share, rare ones first: token, left (how many follow), low.

    If a text and another of no more shingles have the similarity, then a shingle of
    the first one's rows is among the other's rows that are low: what the two share is
    at least `similarity` of the larger, and 2 * similarity / (1 + similarity) of the
    smaller one.
    """
    tokens, counts = _common(docs, shingle)

    def least(share: float, n: int) -> int:
        return math.ceil(share * n - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_numpy(zero_copy_only=False), pc.ascii_lower(batch.column(1)), strict=True):
                own = _shingles(text, shingle)
                if not (n := len(own)):
                    continue
                count = np.zeros(n, np.int32)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    count = np.where(tokens[at] == own, counts[at], 0)
                first = own[np.lexsort((own, count))[: n - least(similarity, n) + 1]]
                k = len(first)
                out.append((np.full(k, doc), np.full(k, n, np.int32), first.view(np.int64), n - 1 - np.arange(k, dtype=np.int32), np.arange(k) <= n - least(2 * similarity / (1 + similarity), n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "size", "token", "left", "low"])
        X.settle()

    return docs.mapInArrow(run, "doc_id long, size int, token long, left int, low boolean")


def _may_pair(x: str, y: str, similarity: float) -> Column:
    """Whether rows x and y of prefixes() with a shingle in common, their texts' first one, leave room for the similarity."""
    col = lambda side, name: F.col(f"{side}.{name}")
    small, large = F.least(col(x, "size"), col(y, "size")), F.greatest(col(x, "size"), col(y, "size"))
    low = (col(x, "low") & (col(x, "size") <= col(y, "size"))) | (col(y, "low") & (col(y, "size") <= col(x, "size")))
    room = 1 + F.least(col(x, "left"), col(y, "left")) >= (small + large) * F.lit(similarity / (1 + similarity)) - 1e-6
    return low & room & (small >= large * F.lit(similarity) - 1e-6)


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text: str) -> set:
            words = text.encode().split()
            return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}

        for batch in batches:
            keep = []
            for x, y in zip(pc.ascii_lower(batch.column(2)).to_pylist(), pc.ascii_lower(batch.column(3)).to_pylist(), strict=True):
                s, t = shingles(x), shingles(y)
                both = len(s & t)
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        X.settle()

    return run


def _confirmed(whole: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    whole = storage.within(whole, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id")
    with_text = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return storage.stored(with_text.select("a", "b", "x", "y").mapInArrow(_similar(shingle, similarity), "a long, b long"))


class Classes(NamedTuple):
    """The distinct texts of a corpus, each known by its SHA-256 (`same`)."""

    rows: DataFrame  # doc_id, same, n: how often a text stands at an id
    nodes: DataFrame  # same, first (its smallest id), node: a number of its own
    others: DataFrame  # doc_id, same of rows but a text's first
    renamed: DataFrame | None  # doc_id, same, node of texts whose first id is also another text's


def _same(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _classes(given: DataFrame) -> Classes:
    """A text's number is its smallest id; where an id is that of several texts, these get numbers that no id has."""
    rows = storage.stored(given.groupBy("doc_id", _same(F.col("text")).alias("same")).agg(F.count("*").alias("n")))
    firsts = storage.stored(rows.groupBy("same").agg(F.min("doc_id").alias("first")))
    shared = firsts.groupBy("first").count().where("count > 1").select("first")
    others = rows.select("doc_id", "same").join(firsts.withColumnRenamed("first", "doc_id"), ["doc_id", "same"], "left_anti")
    if shared.isEmpty():
        return Classes(rows, firsts.withColumn("node", F.col("first")), others, None)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    free = (F.lit(high) + 1 + number) if high < 1 << 62 else (F.lit(low) - 1 - number)
    renamed = storage.stored(firsts.join(shared, "first", "left_semi").select(F.col("first").alias("doc_id"), "same", free.alias("node")))
    nodes = firsts.join(renamed.select("same", "node"), "same", "left").withColumn("node", F.coalesce("node", "first"))
    return Classes(rows, nodes, others, renamed)


def _linked(given: DataFrame, classes: Classes, shingle: int, similarity: float) -> DataFrame:
    """same, first, component_id, kept: of each text that is similar to another its group's smallest id, and whether it is that text."""
    keyed = given.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).withColumn("same", _same(F.col("text")))
    whole = storage.without(keyed, classes.others, ["doc_id", "same"])
    if classes.renamed is not None:
        ids = F.broadcast(classes.renamed) if classes.renamed.count() <= storage.BROADCAST_IDS else classes.renamed
        whole = whole.join(ids, ["doc_id", "same"], "left").withColumn("doc_id", F.coalesce("node", "doc_id"))
    found = _components(whole.select("doc_id", "text"), shingle, similarity)
    linked = storage.stored(found.join(classes.nodes, "node").select("component", "same", "first"))
    kept = linked.groupBy("component").agg(F.min(F.struct("first", "same")).alias("kept"))
    return linked.join(kept, "component").select("same", "first", F.col("kept.first").alias("component_id"), (F.col("kept.same") == F.col("same")).alias("kept"))


def _hashed(whole: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of texts whose fingerprints differ in two bits at most: each with the smallest of its own fingerprint, and these with those of linked fingerprints."""
    prints = storage.stored(fingerprints(whole).select("doc_id", F.col("fingerprint").alias("fp")))
    vertices = storage.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    equal = prints.join(vertices, "fp").where(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    named = lambda side: vertices.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_first"))
    near = links(vertices.select("fp")).join(named("a"), "a").join(named("b"), "b")
    return equal.unionByName(near.select(F.greatest("a_first", "b_first").alias("a"), F.least("a_first", "b_first").alias("b")).distinct())


def _components(whole: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node and component of the texts (doc_id, text; distinct) that are similar to another, by pairs.

    Links are those of SimHash first. What lies beyond its ball meets in the shingles of
    prefixes(), which every similar pair shares: each text is compared with the smallest
    text of each of its shingles unless they are linked, so that thousands of copies
    give a star and not all their pairs; then, of each shingle whose texts are not all
    in one component, all pairs across its components are. Every pair is confirmed by
    its shingles.
    """
    near = storage.stored(_hashed(whole))
    hashed = _confirmed(whole, near, shingle, similarity)
    linked = storage.stored(graph.components(hashed))
    rows = storage.stored(prefixes(whole, shingle, similarity))
    heads = rows.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "size", "left", "low")).alias("head")).where("n > 1")
    shared = storage.stored(rows.join(heads.select("token", "head"), "token"))
    stars = shared.select(F.struct("doc_id", "size", "left", "low").alias("x"), F.col("head").alias("y")).where(F.col("x.doc_id") != F.col("y.doc_id")).where(_may_pair("x", "y", similarity))
    tried = storage.stored(stars.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    of = lambda side: linked.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of"))
    apart = F.coalesce("a_of", "a") != F.coalesce("b_of", "b")
    beyond = tried.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b")
    found = hashed.unionByName(_confirmed(whole, storage.stored(beyond), shingle, similarity))

    named = storage.stored(shared.drop("head").join(graph.components(found).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    open_tokens = named.groupBy("token").agg(F.min("component").alias("m"), F.max("component").alias("n")).where("m < n").select("token")
    open_rows = storage.stored(named.join(open_tokens, "token"))
    sides = open_rows.select("token", "component").distinct()
    across = sides.withColumnRenamed("component", "c").join(sides.withColumnRenamed("component", "d"), "token").where("c < d")
    one = open_rows.select("token", F.col("component").alias("c"), F.struct("doc_id", "size", "left", "low").alias("x"))
    two = open_rows.select("token", F.col("component").alias("d"), F.struct("doc_id", "size", "left", "low").alias("y"))
    met = across.join(one, ["token", "c"]).join(two, ["token", "d"]).where(_may_pair("x", "y", similarity))
    pairs = met.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()
    rest = _confirmed(whole, storage.stored(pairs.join(tried.unionByName(near), ["a", "b"], "left_anti")), shingle, similarity)
    return graph.components(found.unionByName(rest))


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return X.texts(docs, id_col, text_col).where("doc_id is not null and text is not null")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest id reachable by pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

    Equal texts are one class, whatever their ids; a text without words is similar to
    its copies only. An id may have several texts: each row has its own text's
    component. Rows with a null id or null text are left out, a repeated row gives as
    many. An empty table gives no rows.
    """
    given = _given(docs, id_col, text_col)
    classes = _classes(given)
    linked = _linked(given, classes, shingle, similarity).select("same", "component_id")
    each = classes.rows.join(classes.nodes.select("same", "first"), "same").join(linked, "same", "left")
    return each.select("doc_id", F.coalesce("component_id", "first").alias("component_id"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, all columns: of each group of similar texts one row, that of the smallest id.

    What goes is known by its id and its text, so that no text is lost with an id that
    other texts have too; of a row that is repeated one stays. Rows without an id or
    text stay.
    """
    given = _given(docs, "doc_id", "text")
    classes = _classes(given)
    linked = _linked(given, classes, 5, SIMILARITY)
    gone = classes.others.unionByName(linked.where("not kept").select(F.col("first").alias("doc_id"), "same"))
    spare = "_" * (1 + max(map(len, docs.columns)))  # names that docs does not have
    id_key, text_key = f"id{spare}", f"same{spare}"
    named = lambda rows: rows.select(F.col("doc_id").alias(id_key), F.col("same").alias(text_key))
    keyed = docs.withColumns({id_key: docs["doc_id"].cast("long"), text_key: _same(docs["text"].cast("string"))})
    kept = storage.without(keyed, named(gone), [id_key, text_key])
    again = storage.stored(named(classes.rows.where("n > 1")))
    if not again.isEmpty():
        once = storage.within(kept, again, [id_key, text_key]).dropDuplicates([id_key, text_key])
        kept = storage.without(kept, again, [id_key, text_key]).unionByName(once)
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])
