"""Secret scans with DataFrame functions: fixed patterns, and a randomness test battery."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

#: The base patterns, in Java's syntax, in the order in which kinds are listed.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KEPT_LENGTH = 6  # of what an assignment assigns
#: A candidate is a whole run of these characters that has a letter and a digit, with the padding behind it.
RUN = "A-Za-z0-9+/_-"
LEAST_RUN = 20
CANDIDATE = rf"(?<![{RUN}])(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z+/_-]*+[0-9])[{RUN}]{{{LEAST_RUN},}}+=*+"
#: Encodings by their alphabets, the smallest that fits being taken.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Lengths at which a new stratum of the false-discovery control begins.
STRATA = (20, 24, 32, 40, 64, 128)
BINS = 100
#: Share of wrong finds that each stratum may have, as estimated.
RATE = 0.1
#: p-values above this are taken to come from random strings alone.
LAMBDA = 0.5
#: No string of a smaller p-value is found, whatever its stratum.
FLOOR = 0.01
#: Random strings that a stratum is taken to have beside its own: they decide where there are few, and weigh nothing where there are many.
PRIOR = 100
KINDS = (*BASE, "random")
REPLACEMENT = "[secret]"


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a published rational approximation of erf (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    upper = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(rows: DataFrame) -> DataFrame:
    """The rows with p: the p-value that their string `value` is random over the alphabet of its inferred encoding.

    Three tests: chi-squared for even use of the alphabet, runs of its lower and upper
    half, and correlation of neighbours; Fisher's method combines them. A short string
    has few letters to a cell, where chi-squared is far from its limit: the tail is that
    of a gamma distribution with the statistic's exact first three moments. Small values
    speak for structure. Null where the string is null, short or fits no alphabet.
    Padding is left aside. Work on a string is linear in its length.
    """
    alphabet = F.lit(None).cast("string")
    for letters in reversed(ENCODINGS.values()):
        alphabet = F.when(F.col("body").rlike(f"^[{letters.replace('-', chr(92) + '-')}]+$"), F.lit(letters)).otherwise(alphabet)
    halves = F.element_at(F.create_map(*[F.lit(x) for a in ENCODINGS.values() for x in (a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))]), F.col("alphabet"))
    characters = lambda text: F.filter(F.split(text, "(?!^)"), lambda c: c != "")  # noqa: E731  behind the last one the split leaves an empty string
    letters = F.filter(characters("alphabet"), lambda c: F.instr(F.col("body"), c) > 0)
    counts = F.transform(letters, lambda c: F.length("body") - F.length(F.replace(F.col("body"), c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    places = F.transform(characters("body"), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    n, k, ones, mean, centre = F.col("n"), F.col("k"), F.col("ones"), F.col("mean"), F.col("centre")
    start = F.struct(F.lit(0.0).alias("lag"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("v"))
    step = lambda s, v: F.struct((s["lag"] + v * s["v"]).alias("lag"), (s["spread"] + v * v).alias("spread"), v.alias("v"))
    out = (
        rows.select(F.struct(*rows.columns).alias("given"), F.regexp_replace("value", "=+$", "").alias("body"))
        .withColumn("alphabet", F.when(F.length("body") >= LEAST_RUN // 2, alphabet))
        .withColumns({"n": F.length("body").cast("double"), "k": F.length("alphabet").cast("double"), "halves": F.call_function("translate", F.col("body"), F.col("alphabet"), halves), "places": places, "squares": squares})
        .withColumns({"ones": F.length(F.replace(F.col("halves"), F.lit("0"), F.lit(""))).cast("double"), "runs": F.length(F.regexp_replace("halves", "0+|1+", "x")).cast("double"), "centre": F.aggregate("places", F.lit(0.0), lambda s, v: s + v) / n})
        .withColumns({"mean": 2 * ones * (n - ones) / n + 1, "pairs": n * (n - 1) / 2 / k, "equal": (F.col("squares") - n) / 2, "moments": F.aggregate(F.transform("places", lambda v: v - centre), start, step), "spread": F.sqrt(F.col("pairs") * (1 - 1 / k))})
        .withColumns({"deviate": (F.col("equal") - 0.5 - F.col("pairs")) / F.col("spread"), "root": 2 * F.col("spread") / (1 - 2 / k + 2 * (n - 2) / k)})  # root: of the gamma's shape, 2 / skewness
        .withColumns(
            {
                "z1": 3 * F.col("root") * (F.cbrt(F.greatest(1 + F.col("deviate") / F.col("root"), F.lit(0.0))) - 1) + 1 / (3 * F.col("root")),  # Wilson and Hilferty's cube root
                "z2": F.abs((F.col("runs") - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))),
                "z3": F.abs((F.col("moments.lag") / F.greatest("moments.spread", F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n)),
            }
        )
        .withColumns({"p1": _tail(F.col("z1")), "p2": 2 * _tail(F.col("z2")), "p3": 2 * _tail(F.col("z3"))})
        .withColumn("half", -sum((F.log(F.greatest(c, F.lit(1e-300))) for c in ("p1", "p2", "p3")), F.lit(0.0)))
    )
    half = F.col("half")
    return out.select("given.*", F.when(F.col("alphabet").isNotNull(), F.exp(-half) * (1 + half + half * half / 2)).alias("p"))


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Each match with the length of what lies between it and the one before."""
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    each = F.transform(pairs, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x["value"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,value:string>>"))


def _pieces(rows: DataFrame, every_row: bool) -> DataFrame:
    """Of rows (id, text): a row for each match, its value's place and, of a candidate, its p-value; a text without any has one empty row, if asked."""
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    every = F.flatten(F.array(*[_found(F.col("text"), k, p) for k, p in BASE.items()], _found(F.col("text"), "random", CANDIDATE)))
    exploded = rows.select("row", "id", (F.explode_outer if every_row else F.explode)(every).alias("x")).select("row", "id", "x.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = exploded.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before))
    long_enough = (F.col("kind") != KINDS.index("assign")) | (F.length(F.regexp_extract("value", BASE["assign"], 1)) >= KEPT_LENGTH)
    n = F.length("value")
    stratum = F.lit(0)
    for s in STRATA:
        stratum = F.when(n >= s, F.lit(s)).otherwise(stratum)
    span = F.when(F.col("kind").isNotNull() & long_enough, F.struct((F.col("end") - n).alias("start"), "kind", "end"))
    candidate = F.when(F.col("kind") == KINDS.index("random"), F.col("value"))
    return battery(placed.select("row", "id", span.alias("span"), stratum.alias("stratum"), candidate.alias("value"))).drop("value")


def thresholds(candidates: DataFrame, rate: float = RATE) -> DataFrame:
    """The least p-value of a find, by stratum of length (p, stratum in; stratum, least_p out).

    Random strings have even p-values, so the share above LAMBDA tells how many there
    are; what lies at or above a threshold beyond their due number is estimated to be
    false. Each stratum takes the lowest threshold that holds the rate, as short
    strings of structure look random more often than long ones, but none below FLOOR.
    PRIOR random strings are counted beside a stratum's own, so that a lone string is
    judged by the battery alone: a random one is found with probability 1 - FLOOR,
    whether the corpus has one or millions. The price is that up to PRIOR * rate /
    (1 - rate) strings of structure may pass before the estimate turns against them.
    The histogram has at most BINS rows a stratum, whatever the corpus.
    """
    counts = candidates.where("p is not null").groupBy("stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).count()
    # Every bin may be the threshold, whether a string lies in it or not.
    binned = counts.select("stratum").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")))).join(counts, ["stratum", "bin"], "left").fillna(0, ["count"])
    above = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum")
    random = (F.sum(F.when(F.col("bin") >= LAMBDA * BINS, F.col("count")).otherwise(0)).over(whole) + PRIOR * (1 - LAMBDA)) / (1 - LAMBDA)
    even = 1 - F.col("bin") / BINS
    wrong = 1 - random * even / (F.sum("count").over(above) + PRIOR * even)
    least = binned.withColumn("wrong", wrong).where(F.col("wrong") <= rate).groupBy("stratum").agg((F.min("bin") / BINS).alias("least_p"))
    return least.select("stratum", F.greatest("least_p", F.lit(FLOOR)).alias("least_p"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end>> of every text: code points, end exclusive, by start, then kind.

    Kinds are places in KINDS. Base patterns give their leftmost non-overlapping
    matches. Runs of encoding characters that no base span touches are kept as kind
    "random" if the battery's p-value reaches their length's threshold. Null texts
    count as empty and have no spans; a null id stays null; repeated rows are each
    scanned; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return _spans(docs.select(docs[id_col].cast("long").alias("id"), text.alias("text")), rate).withColumnRenamed("id", "doc_id")


def _spans(rows: DataFrame, rate: float, every_row: bool = True) -> DataFrame:
    """row, id, spans of every row (id, text), or of those with a match."""
    pieces = storage.stored(_pieces(rows, every_row))
    limits = thresholds(pieces, rate)
    judged = pieces.join(F.broadcast(limits), "stratum", "left")  # a row for each of the few strata
    is_random = F.col("span.kind") == KINDS.index("random")
    base, random = F.collect_list(F.when(~is_random, F.col("span"))), F.collect_list(F.when(is_random & (F.col("p") >= F.col("least_p")), F.col("span")))
    grouped = judged.groupBy("row", "id").agg(F.array_sort(base).alias("base"), F.array_sort(random).alias("random"))
    alone = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return grouped.select("row", "id", F.array_sort(F.concat("base", alone)).alias("spans"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), counts[-1])


#: Bytes of spans that may be broadcast; beyond it, the texts that may hold secrets meet them in a shuffle.
BROADCAST_BYTES = 16 << 20


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", rate: float = RATE) -> DataFrame:
    """The rows and columns of docs, each text without its secrets: overlapping spans are one, and become REPLACEMENT.

    Spans depend on the text alone, and meet it again by its SHA-256: a row without an
    id is mended like any other, rows that repeat (with one text or several) stay as
    many as they were, and one text is mended alike everywhere. length_col, where there
    is such a column, is set anew for a text that changed. Null and empty texts, other
    columns of any name and rows without secrets stay as they are; an empty table
    gives no rows.
    """
    whole = "row" + "_" * max(map(len, docs.columns))  # no column of docs
    column = lambda name: F.col(f"{whole}.`{name}`")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(whole))
    text, key = column(text_col), F.sha2(column(text_col), 256)
    found = _spans(rows.select(key.alias("id"), text.alias("text")), rate, every_row=False).groupBy(F.col("id").alias("key")).agg(F.any_value("spans").alias("spans"))
    each = found.select("key", F.explode("spans").alias("x")).select("key", "x.start", "x.end")
    earlier = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    # Where a span overlaps one before it, the two are one; what is kept lies between.
    opens = each.withColumn("from", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long"))).withColumn("gap", F.when(F.col("start") >= F.col("from"), F.struct("from", F.col("start").alias("to"))))
    spans = storage.stored(opens.groupBy("key").agg(F.array_sort(F.collect_list("gap")).alias("gaps"), F.max("end").alias("last")))
    size = spans.agg(F.sum(96 + 24 * F.size("gaps"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rest, joined = None, rows.withColumn("key", key).join(F.broadcast(spans), "key", "left")
    else:  # texts that no pattern touches stay where they are
        may = F.coalesce(sum((text.rlike(p).cast("int") for p in (*BASE.values(), CANDIDATE)), F.lit(0)) > 0, F.lit(False))
        rest, joined = rows.where(~may), rows.where(may).withColumn("key", key).join(spans, "key", "left")
    kept = F.transform("gaps", lambda g: F.substring(text, (g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int")))
    behind = F.substring(text, (F.col("last") + 1).cast("int"), F.length(text))
    clean = F.when(F.col("gaps").isNull(), text).otherwise(F.concat(F.array_join(kept, REPLACEMENT), F.lit(REPLACEMENT), behind))
    changed = {text_col: clean.cast(docs.schema[text_col].dataType)}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col("gaps").isNull(), column(length_col)).otherwise(F.length(clean)).cast(docs.schema[length_col].dataType)
    mended = joined.select(*[changed.get(c, column(c)).alias(c) for c in docs.columns])
    return mended if rest is None else rest.select(*[column(c).alias(c) for c in docs.columns]).unionByName(mended)
