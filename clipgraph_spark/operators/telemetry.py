"""Latency, budgets, usage, queues and job status over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_BUDGET_MS, STAGE_BUDGETS


#: Accuracy of the sketch that brackets percentiles: its ranks are off by at most a stage's rows over this.
SKETCH = 20_000


def latency_stats(events: DataFrame, stage: str = "stage", value: str = "elapsed_ms") -> DataFrame:
    """(stage, n, p50, p95, max): p50 is the middle or the mean of the two, p95 the element max(0, int(.95 n) - 1).

    A mergeable sketch gives, for each place sought, two values between which it must lie: about 6 in SKETCH of a
    stage's rows, however its values are spread, or all rows of a stage of up to SKETCH. Rows below are counted, those
    between are counted by value, and only these counts are sorted.
    """
    e = events.where(F.col(value).isNotNull()).select(F.col(stage).alias("_s"), F.col(value).alias("_v"))
    reach = 3 / SKETCH  # the sketch's own error, and the ranks' rounding
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in (0.5 - reach, 0.5 + reach, 0.95 - reach, min(1.0, 0.95 + reach))]), SKETCH)
    per = e.groupBy("_s").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), sketch.alias("q"))
    few = F.col("n") <= SKETCH

    def place(kind, first, last, at):
        low, high = (F.when(few, end).otherwise(F.get("q", F.lit(i))) for end, i in ((F.col("lo"), at), (F.col("hi"), at + 1)))
        return F.struct(F.lit(kind).alias("kind"), first.cast("long").alias("first"), last.cast("long").alias("last"), low.alias("low"), high.alias("high"))

    p95 = F.greatest(F.lit(0), F.floor(F.col("n") * 95 / 100) - 1)
    both = F.array(place("p50", F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), 0), place("p95", p95, p95, 2))
    sought = per.select(F.col("_s").alias("_t"), F.explode(both).alias("p")).select("_t", "p.*")
    near = e.join(sought, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_v") <= F.col("high")))
    counts = near.groupBy("_s", "kind", "first", "last", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("v")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("_s", "kind").orderBy(F.col("v").asc_nulls_first())))
    at = lambda p, kind: F.min(F.when((F.col("kind") == kind) & (F.col("upto") > F.col(p)), F.col("v")))
    found = counts.groupBy(F.col("_s").alias("_t")).agg(((at("first", "p50") + at("last", "p50")) / 2).alias("p50"), at("first", "p95").alias("p95"))
    return per.join(found, F.col("_s").eqNullSafe(F.col("_t"))).select(F.col("_s").alias(stage), "n", "p50", "p95", F.col("hi").alias("max"))


def running_sum(events: DataFrame, key: str, amount: Column, out: str, span: str = "hour") -> DataFrame:
    """Adds the sum of `amount` over a key's rows so far, by ts and seq: sums of each span of time first, then inside a
    span, so that a key of very many rows takes many tasks. Needs ts and seq."""
    e = events.withColumns({"_span": F.date_trunc(span, F.col("ts").cast("timestamp")), "_n": amount})
    spans = e.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_at")).agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select("_k", "_at", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_span").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = e.join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_at")))
    return x.withColumn(out, F.col("_before") + F.sum("_n").over(inside)).drop("_span", "_n", "_k", "_at", "_before")


def with_budget(events: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    rows = [(k, float(v)) for k, v in (budgets or STAGE_BUDGETS).items()]
    table = events.sparkSession.createDataFrame(rows, "stage string, budget_ms double")
    return events.join(F.broadcast(table), "stage", "left").withColumn("budget_ms", F.coalesce("budget_ms", F.lit(float(DEFAULT_BUDGET_MS))))


def budget_status(events: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    used = F.col("elapsed_ms") / F.col("budget_ms")
    return with_budget(events, budgets).withColumn("status", F.when(used > 1, "exceeded").when(used > 0.8, "warning").otherwise("ok"))


def budget_enforcement(events: DataFrame, budgets: dict[str, int] | None = None, max_warnings: int = 3) -> DataFrame:
    """Adds warnings (runs over 80 % so far) and disabled: from the run that makes it max_warnings on. Needs seq."""
    e = running_sum(budget_status(events, budgets), "stage", (F.col("status") != "ok").cast("int"), "warnings")
    return e.withColumn("disabled", F.col("warnings") >= max_warnings)


def run_summary(events: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return events.groupBy("run_id").agg(F.round(F.sum("elapsed_ms"), 3).alias("total_ms"), F.count("*").alias("executed"), n("succeeded"), n("failed"), n("skipped"))


def usage_60s(events: DataFrame, tpm: int = 6000, rpm: int = 30) -> DataFrame:
    """Adds tokens_60s and requests_60s (this one included) and the room left under 80 % and 70 % of the limits."""
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-60_000_000, 0)
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumns({"tokens_60s": F.sum("tokens").over(w), "requests_60s": F.count("*").over(w)}).drop("us")
    return e.withColumns({"token_room": F.greatest(F.lit(0.0), F.lit(tpm * 0.8) - F.col("tokens_60s")), "request_room": F.greatest(F.lit(0.0), F.lit(rpm * 0.7) - F.col("requests_60s"))})


def queue_times(events: DataFrame) -> DataFrame:
    """Averages over requests of the time from queued to started to completed. Needs request_id, name, ts."""
    at = lambda n: F.min(F.when(F.col("name") == n, F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    r = events.groupBy("key", "request_id").agg(at("queued").alias("q"), at("started").alias("s"), at("completed").alias("c"))
    return r.groupBy("key").agg(F.count("*").alias("requests"), F.round(F.avg(F.col("s") - F.col("q")), 3).alias("wait_ms"), F.round(F.avg(F.col("c") - F.col("s")), 3).alias("run_ms"))


def queue_depth(events: DataFrame) -> DataFrame:
    """(key, peak_depth, submitted, completed, failed): +1 at queued, -1 at completed or failed."""
    done = F.col("name").isin("completed", "failed")
    delta = F.when(F.col("name") == "queued", 1).when(done, -1).otherwise(0)
    e = running_sum(events, "key", delta, "depth")
    n = lambda s: F.count_if(F.col("name") == s)
    return e.groupBy("key").agg(F.greatest(F.lit(0), F.max("depth")).cast("long").alias("peak_depth"), n("queued").alias("submitted"), n("completed").alias("completed"), n("failed").alias("failed"))


def failure_runs(events: DataFrame, threshold: int = 3) -> DataFrame:
    """(key, run, weight, first_ts, last_ts) of failures without a success between them that weigh at least the
    threshold; a rate-limit failure weighs 2. Needs ok, rate_limited, ts, seq."""
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("run", F.sum(F.col("ok").cast("int")).over(w)).where(~F.col("ok"))
    weight = F.sum(F.when(F.col("rate_limited"), 2).otherwise(1))
    return e.groupBy("key", "run").agg(weight.alias("weight"), F.count("*").alias("failures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where(F.col("weight") >= threshold)


FINAL = ("complete", "failed", "cancelled")


def job_status(events: DataFrame) -> DataFrame:
    """(job_id, status, progress, completed_at) from the latest event of each job; progress is clamped to 0..1."""
    last = F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq"))
    e = events.groupBy("job_id").agg(last.alias("x"))
    return e.select("job_id", "x.status", F.least(F.greatest("x.progress", F.lit(0.0)), F.lit(1.0)).alias("progress"), F.when(F.col("x.status").isin(*FINAL), F.col("x.ts")).alias("completed_at"))
