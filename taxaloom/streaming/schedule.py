"""When calls may go out: least intervals, waits after refusals, and who waits for whom, worked out for all callers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between calls without and with a key, the first wait, the longest wait a server may ask for, calls in all.
GAP, GAP_WITH_KEY, FIRST_WAIT, LONGEST_ASKED, ATTEMPTS = 0.35, 0.11, 0.5, 30.0, 3
#: Answers after which a call is tried again.
RETRYABLE = (429, 500, 502, 503, 504)
MICROS = 1_000_000


def micros(seconds: float | Column) -> Column:
    return F.round((seconds if isinstance(seconds, Column) else F.lit(seconds)) * MICROS).cast("long")


def released(rows: DataFrame, by: str, order: list[str], at: str = "at", gap: str = "gap", stretch: int = 1 << 16) -> DataFrame:
    """The rows with `release`: the later of a row's own time and the release before it plus its gap, by caller, in order.

    at and gap are whole numbers (microseconds); a null `at` waits for nothing but the
    row before, the first row of a caller has no gap. With G the running sum of gaps,
    release = G + the running maximum of at - G, so that a caller is no chain of steps
    but a scan: rows are numbered, stretches of a caller's rows are scanned apart, and
    what the stretches before sum up to is a few rows. The caller's rows are dealt to
    stretches by ranges of the first column of the order (a time or a number, taken as
    a long), `stretch` wide.
    """
    place = F.floor(F.col(order[0]).cast("double") / stretch).cast("long")
    within = Window.partitionBy(by, "__stretch").orderBy(*order)
    scan = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy(by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__stretch", place).withColumn("__sum", F.sum(gap).over(scan)).withColumn("__peak", F.max(F.col(at) - F.col("__sum")).over(scan))
    sums = inner.groupBy(by, "__stretch").agg(F.sum(gap).alias("__whole"), F.max(F.col(at) - F.col("__sum")).alias("__top"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__whole").over(first), F.lit(0)))
    sums = sums.withColumn("__reached", F.max(F.col("__top") - F.col("__before")).over(first)).select(F.col(by), "__stretch", "__before", "__reached")
    joined = inner.join(sums, (inner[by].eqNullSafe(sums[by])) & (inner["__stretch"].eqNullSafe(sums["__stretch"]))).select(inner["*"], "__before", "__reached")
    release = F.col("__sum") + F.col("__before") + F.greatest("__reached", F.col("__peak") - F.col("__before"))
    return joined.select(*rows.columns, release.alias("release"))


def limited(calls: DataFrame, by: str, at: str, tie: str, least_seconds: float = GAP) -> DataFrame:
    """The calls with `release` (a timestamp): none goes out sooner than the interval after the caller's one before."""
    numbered = calls.withColumns({"__at": F.unix_micros(F.col(at).cast("timestamp")), "__gap": micros(least_seconds)})
    found = released(numbered, by, ["__at", tie], "__at", "__gap", stretch=3600 * MICROS)
    # The first call's gap stands in all sums, and in all differences: it falls out.
    return found.select(*calls.columns, F.timestamp_micros("release").alias("release"))


def wait_after(status: Column, retry_after: Column, attempt: Column, first_wait: float = FIRST_WAIT, longest: float = LONGEST_ASKED) -> Column:
    """Seconds to wait after a retryable answer to the attempt (from 0): what the server asks for with a 429, at most `longest`, else doubled each time."""
    asked = F.when((status == 429) & (retry_after >= 0), F.least(retry_after.cast("double"), F.lit(longest)))
    return F.coalesce(asked, F.lit(first_wait) * F.pow(F.lit(2.0), attempt))


def attempts(calls: DataFrame, answers: str = "answers", most: int = ATTEMPTS) -> DataFrame:
    """A row for each attempt of a call, from its answers (array of struct<status, retry_after>): attempt, status, retry_after, last, outcome.

    A call is tried again after a retryable answer, up to `most` times in all. outcome,
    of the last attempt: "answered", "refused" (another error) or "given up".
    """
    got = F.slice(F.col(answers), 1, most)
    tried = F.transform(got, lambda a, k: F.struct(k.alias("attempt"), a["status"].alias("status"), a["retry_after"].alias("retry_after")))
    ended = F.array_min(F.transform(F.filter(tried, lambda a: ~a["status"].isin(*RETRYABLE)), lambda a: a["attempt"]))
    kept = F.filter(tried, lambda a: a["attempt"] <= F.coalesce(ended, F.lit(most)))
    each = calls.withColumn("__n", F.size(kept)).withColumn("__a", F.explode(kept)).select(*[c for c in calls.columns if c != answers], "__n", "__a.*")
    last = F.col("attempt") == F.col("__n") - 1
    outcome = F.when(last, F.when(F.col("status").isin(*RETRYABLE), "given up").when(F.col("status") < 400, "answered").otherwise("refused"))
    return each.withColumns({"last": last, "outcome": outcome}).drop("__n")


def retried(calls: DataFrame, by: str, at: str, tie: str, least_seconds: float = GAP) -> DataFrame:
    """attempts() with `release`: a caller works through its calls one by one, waits out each refusal, and keeps the interval."""
    each = attempts(calls).withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    order = ["__at", tie, "attempt"]
    wait = F.when(~F.col("last"), micros(wait_after(F.col("status"), F.col("retry_after"), F.col("attempt"))))
    gap = F.greatest(micros(least_seconds), F.coalesce(F.lag(wait).over(Window.partitionBy(by, tie).orderBy("attempt")), F.lit(0)))
    own = F.when(F.col("attempt") == 0, F.col("__at"))
    found = released(each.withColumns({"__gap": gap, "__own": own}), by, order, "__own", "__gap", stretch=3600 * MICROS)
    return found.drop("__at", "__gap", "__own").withColumn("release", F.timestamp_micros("release"))
