"""Keyed operators on streams that need a key's rows in order: rows wait in state until the watermark passes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs; set on the session before the query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

HOUR_US = 3_600_000_000
#: Up to this many waiting rows of a key stand in one list, whose place among the hours is SHORT.
MANY, SHORT = 4096, -(1 << 62)

Step = Callable[[int, list[tuple]], tuple[int, list[tuple]]]


class _InOrder(StatefulProcessor):
    """Rows of a key wait in one list, or, where they are many, by the hour of their ts: state is read and written once a
    list, not once a row. When the watermark reaches them they leave by (ts, seq), and `step` turns the key's number so far and the rows of a
    millisecond into the next number and the rows to give out.

    One timer a key stands at its earliest waiting row, or, where none waits, `idle_ms` after its last: then all that
    is kept of the key goes, and it begins anew at 0.
    """

    def __init__(self, fields: list[str], row: str, step: Step, out: list[str], key: str, idle_ms: int):
        self.fields, self.row, self.step, self.out, self.key, self.idle_ms = fields, row, step, out, key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long", f"rows array<struct<{self.row}>>")
        self.state = handle.getValueState("state", "number long, last_ms long")

    def _rows(self, hour: int) -> list[tuple]:
        return [tuple(x) for x in self.waiting.getValue((hour,))[0]] if self.waiting.containsKey((hour,)) else []

    def _keep(self, hour: int, rows: list[tuple]) -> None:
        if rows:
            self.waiting.updateValue((hour,), (rows,))
        elif self.waiting.containsKey((hour,)):
            self.waiting.removeKey((hour,))

    def _wait(self, now: int | None) -> None:
        """Leaves one timer: at the earliest waiting row, or at the end of the key's rest."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        hours = sorted(k[0] for k in self.waiting.keys())
        # each list is in order; the short one stands before the hours
        first = min((self._rows(h)[0][0] // 1000 for h in hours[: 2 if hours[:1] == [SHORT] else 1]), default=None)
        if first is None and self.state.exists():
            first = self.state.get()[1] + self.idle_ms
        if first is not None:
            self.handle.registerTimer(first if now is None else max(first, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = self._rows(SHORT) + [r for frame in rows for r in frame[self.fields].itertuples(index=False, name=None)]
        new.sort()
        if len(new) <= MANY:
            self._keep(SHORT, new)
        else:
            self._keep(SHORT, [])
            for hour, part in groupby(new, lambda r: r[0] // HOUR_US):
                self._keep(int(hour), sorted(self._rows(int(hour)) + list(part)))
        self._wait(None)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        hours = {k[0] for k in self.waiting.keys()} - {SHORT}
        parts = {h: list(r) for h, r in groupby(self._rows(SHORT), lambda r: r[0] // HOUR_US)}
        short: list[tuple] = []
        out: list[tuple] = []
        number, last = self.state.get() if self.state.exists() else (0, None)
        any_due = False
        for hour in sorted(hours | set(parts)):
            if hour * HOUR_US > now * 1000 + 999:
                short += parts.get(hour, [])
                continue
            left = []
            rows = parts.get(hour, [])
            for ms, at_once in groupby(sorted(rows + self._rows(hour)) if hour in hours else rows, lambda r: r[0] // 1000):
                if ms > now:
                    left += at_once
                    continue
                number, last, any_due = number if last is not None and ms - last <= self.idle_ms else 0, ms, True
                number, found = self.step(number, list(at_once))
                out += found
            if hour in hours:
                self._keep(hour, left)
            else:
                short += left
            if len(out) >= MANY:
                yield pd.DataFrame(out, columns=self.out).assign(**{self.key: key[0]})
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.out).assign(**{self.key: key[0]})
        if parts:
            self._keep(SHORT, short)
        if any_due:
            self.state.update((int(number), last))
        elif self.state.exists() and self.state.get()[1] + self.idle_ms <= now:
            self.state.clear()
        self._wait(now)

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, key: str, values: str, step: Step, out: str, watermark: str, idle: str) -> DataFrame:
    """The rows that `step` gives out for each key, in append mode; `values` are the fields it gets after us and seq."""
    spark = stream.sparkSession
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"keyed state with timers needs {STORE[0]}={STORE[1]}")
    kind = stream.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(out).fields])
    row = T.StructType.fromDDL(f"us long, seq long, {values}")
    e = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", watermark)
    idle_ms = spark.sql(f"SELECT INTERVAL {idle} AS i").first()["i"].total_seconds() * 1000
    names = [f.name for f in row.fields]
    processor = _InOrder(names, ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in row.fields), step, schema.names[1:], key, int(idle_ms))
    return e.select(key, "ts", *names).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime").select(*schema.names)


def _warned(max_warnings: int) -> Step:
    def step(count, rows):
        out = []
        for _, seq, elapsed, budget in rows:
            count += elapsed > 0.8 * budget
            out.append((seq, count, count >= max_warnings))
        return count, out

    return step


def budget_enforcement(stream: DataFrame, max_warnings: int = 3, watermark: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """(stage, seq, warnings, disabled): running warnings by stage in the order of (ts, seq), as the batch operator has them.

    Needs stage, ts, seq, elapsed_ms and budget_ms. Rows later than the watermark are dropped; a stage without rows for
    `idle` begins anew.
    """
    return _in_order(stream, "stage", "elapsed_ms double, budget_ms double", _warned(max_warnings), "seq long, warnings int, disabled boolean", watermark, idle)


def _failing(threshold: int) -> Step:
    def step(weight, rows):
        out = []
        for _, seq, ok, rate_limited in rows:
            own = 0 if ok else 2 if rate_limited else 1
            weight = 0 if ok else weight + own
            if not ok and weight >= threshold > weight - own:
                out.append((seq, weight))
        return weight, out

    return step


def failure_alarms(stream: DataFrame, threshold: int = 3, watermark: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """(key, seq, weight) each time that a key's failures since its last success come to weigh the threshold or more.

    Needs key, ts, seq, ok and rate_limited; a rate-limit failure weighs 2. Rows are taken by (ts, seq); those later
    than the watermark are dropped, and a key without rows for `idle` begins anew.
    """
    return _in_order(stream, "key", "ok boolean, rate_limited boolean", _failing(threshold), "seq long, weight int", watermark, idle)


class _Latest(StatefulProcessor):
    """The last row of a key by (ts, seq). It goes out when it changes; `idle_ms` after it the key is forgotten."""

    def __init__(self, values: list[str], schema: str, out: list[str], idle_ms: int):
        self.values, self.schema, self.out, self.idle_ms = values, schema, out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.last.get()) if self.last.exists() else None
        new = old
        for frame in rows:
            best = frame.sort_values(["us", "seq"]).iloc[-1]
            if new is None or (best["us"], best["seq"]) > new[:2]:
                new = (int(best["us"]), int(best["seq"]), *[best[c] for c in self.values])
        if new != old:
            self.last.update(new)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(new[0] // 1000 + self.idle_ms)
            yield pd.DataFrame([(key[0], *new)], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_status(stream: DataFrame, watermark: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """(job_id, us, seq, status, progress) of each job whenever a later row than before comes, in update mode.

    us is the row's ts in microseconds. Rows later than the watermark are dropped, and a job without rows for `idle` is
    forgotten. With BatchTable(keys=("job_id",), order=("us", "seq")) as sink the table has each job's latest status.
    """
    spark = stream.sparkSession
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"keyed state with timers needs {STORE[0]}={STORE[1]}")
    row = "us long, seq long, status string, progress double"
    schema = T.StructType([T.StructField("job_id", stream.schema["job_id"].dataType), *T.StructType.fromDDL(row).fields])
    idle_ms = spark.sql(f"SELECT INTERVAL {idle} AS i").first()["i"].total_seconds() * 1000
    e = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", watermark)
    processor = _Latest(["status", "progress"], row, schema.names, int(idle_ms))
    return e.select("job_id", "ts", "us", "seq", "status", F.col("progress").cast("double").alias("progress")).groupBy("job_id").transformWithStateInPandas(processor, schema, "update", "eventTime")
