"""Structured Streaming: windowed counts, time-bound joins, limits and circuit breaking with keyed state.

The stateful operators are plain step functions over ordered events of one key. The batch form carries
each key's state from one range of time to the next (``by_ranges``), so no task holds more of a key than
one range; the streaming form (``applyInPandasWithState``) calls the same step.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import fresh, shared_folder, stored  # noqa: F401

BREAKER = "client string, ts timestamp, ok boolean, admitted boolean, state string"
LIMITER = "client string, ts timestamp, allowed boolean, remaining int"


def events(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of parquet, or over one file of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return src.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return src.parquet(path)


def daily_usage(df: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Tumbling days; what comes later than the watermark is dropped."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", "value")


def sliding_rate(df: DataFrame, ts: str = "ts", size: str = "5 minutes", step: str = "15 seconds", late: str = "1 hour") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", (F.col("n") / 5.0).alias("per_minute"))


def requests_with_feedback(requests: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback within an hour of its request, both sides under watermarks, so state is bounded."""
    r = requests.withWatermark("event_ts", "1 hour").alias("r")
    f = feedback.withWatermark("feedback_ts", "1 hour").alias("f")
    return f.join(r, F.expr("f.request_id = r.request_id AND f.feedback_ts >= r.event_ts AND f.feedback_ts <= r.event_ts + INTERVAL 1 HOUR"))


def limit_step(log: list[float], t: float, limit: int, seconds: float) -> tuple[list[float], bool, int]:
    """Accepted calls of the last window; a rejected call leaves no trace."""
    log = [x for x in log if x > t - seconds]
    ok = len(log) < limit
    return (log + [t] if ok else log), ok, max(0, limit - len(log) - ok)


def breaker_step(s: tuple[str, int, int, float], t: float, ok: bool, most: int = 5, wait: float = 30.0, needed: int = 3) -> tuple[tuple[str, int, int, float], bool]:
    """(state, failures, successes, opened at) and whether the call is admitted."""
    state, fails, good, opened = s
    if state == "open":
        if t - opened < wait:
            return s, False
        state, good = "half_open", 0
    if state == "half_open":
        if not ok:
            return ("open", fails, 0, t), True
        good += 1
        return (("closed", 0, 0, 0.0) if good >= needed else (state, fails, good, opened)), True
    fails = 0 if ok else fails + 1
    return (("open", fails, 0, t) if fails >= most else ("closed", fails, 0, 0.0)), True


def budget_step(s: tuple[list[float], int, float], t: float, rpm: int, daily: int) -> tuple[tuple[list[float], int, float], bool]:
    """(calls of the last minute, calls of the day, the day's start): an outside call is made within both budgets."""
    log, n, start = s
    if t - start >= 86_400:
        n, start = 0, t
    log = [x for x in log if x > t - 60]
    ok = len(log) < rpm and n < daily
    return ((log + [t], n + 1, start) if ok else (log, n, start)), ok


def gated_step(state, t: float, prompt: str, answer, rpm: int, daily_cost: float, cost_of, most: int, wait: float, needed: int, retries: int):
    """One call of an outside judge behind budget and breaker: (state, (status, answer)).

    A call that the gates stop costs nothing and does not count against the minute. A call is tried ``retries`` times before it counts as one failure.
    """
    minute, cost, day, breaker = state or ([], 0.0, t, ("closed", 0, 0, 0.0))
    if t - day >= 86_400:
        minute, cost, day = [], 0.0, t
    minute = [x for x in minute if x > t - 60]
    if cost >= daily_cost:
        return (minute, cost, day, breaker), ("cost_cap", None)
    if len(minute) >= rpm:
        return (minute, cost, day, breaker), ("rate_limited", None)
    if breaker[0] == "open" and t - breaker[3] < wait:
        return (minute, cost, day, breaker), ("breaker_open", None)
    said = None
    for _ in range(max(1, retries)):
        try:
            said = answer(prompt)
            break
        except Exception:  # the next try, or a failure for the breaker
            continue
    breaker, _ = breaker_step(breaker, t, said is not None, most, wait, needed)
    if said is None:
        return (minute, cost, day, breaker), ("failed", None)
    return ([*minute, t], cost + (cost_of(prompt, said) if cost_of else 0.0), day, breaker), ("called", said)


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds to wait before the next try: doubled each time up to ``most``, plus that share of it (0 to 1)."""
    delay = min(base * 2**attempt, most)
    return delay * (1 + jitter)


#: Rows of one key that one task holds at most, as far as events of one second allow.
MOST_ROWS = 100_000


def by_ranges(df: DataFrame, step: Callable, result: str, most: int | None = None) -> DataFrame:
    """df (client, ts, further columns) with the result of ``step(state, row) -> (state, result)`` over each client's rows by time.

    Rows of equal time go by key or event_id, if there is one. Time is cut into ranges in which no client has more than ``most`` rows
    (never within a second); ranges follow each other, and each client's state goes on from one to the next through a stored table.
    Null clients and times have no order and are left out. The driver holds one number per range boundary.
    """
    most = most or MOST_ROWS
    src = df.where("client is not null and ts is not null")
    tie = next((c for c in ("event_id", "key") if c in df.columns), None)
    out_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {result}"
    names = [f.name for f in df.schema.fields]
    more = [x.split()[0] for x in result.split(", ")]

    def run(rows: pd.DataFrame, held) -> tuple[pd.DataFrame, object]:
        state, out = held, []
        rows = rows.sort_values(["ts", tie] if tie else "ts", kind="stable")
        for r in rows.itertuples(index=False):
            state, got = step(state, r)
            out.append(got)
        return rows[names].assign(**{c: [x[i] for x in out] for i, c in enumerate(more)}), state

    edges = _edges(src, most)
    if len(edges) == 2:  # one range: no state to carry
        return src.groupBy("client").applyInPandas(lambda rows: run(rows, None)[0], out_schema)
    both = f"{out_schema}, _state binary"
    empty = src.sparkSession.createDataFrame([], "client string, _state binary")
    state, parts = empty, []
    for lo, hi in zip(edges, edges[1:], strict=False):
        rows = src.where((F.unix_timestamp("ts") >= lo) & (F.unix_timestamp("ts") < hi))

        def both_sides(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            held = pickle.loads(old["_state"].iloc[0]) if len(old) else None
            done, now = run(new, held)
            last = pd.DataFrame([{c: None for c in done.columns} | {"client": key[0], "_state": pickle.dumps(now)}])
            return pd.concat([done.assign(_state=None).astype(object), last.astype(object)], ignore_index=True)

        part = stored(rows.groupBy("client").cogroup(state.groupBy("client")).applyInPandas(both_sides, both))
        parts.append(part.where("_state is null").drop("_state"))
        state = part.where("_state is not null").select("client", "_state")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(src: DataFrame, most: int) -> list[int]:
    """Seconds at which ranges begin, and the end: days put together, and those of too many rows of one client cut into hours, minutes, seconds."""
    def counts(seconds: int, within: DataFrame) -> list[tuple[int, int]]:
        at = F.floor(F.unix_timestamp("ts") / seconds) * seconds
        per = within.groupBy("client", at.alias("at")).agg(F.count("*").alias("n")).groupBy("at").agg(F.max("n").alias("n"))
        return sorted((r["at"], r["n"]) for r in per.collect())  # one row per day (hour ...) of the calendar

    cells: list[tuple[int, int]] = []
    todo = [(86_400, src)]
    while todo:
        seconds, within = todo.pop()
        got = counts(seconds, within)
        finer = {86_400: 3_600, 3_600: 60, 60: 1}.get(seconds)
        big = [a for a, n in got if n > most and finer]
        cells += [(a, n) for a, n in got if a not in set(big)]
        if big:
            todo.append((finer, within.where((F.floor(F.unix_timestamp("ts") / seconds) * seconds).isin(big))))
    edges, total = [], 0
    for a, n in sorted(cells):
        if not edges or total + n > most:
            edges.append(a)
            total = 0
        total += n
    return [*edges, 1 << 40] if edges else [0, 1 << 40]


def limiter_batch(df: DataFrame, limit: int = 2, seconds: float = 3600.0, most: int | None = None) -> DataFrame:
    """df: client, ts (and event_id). Accepted calls of the last window decide."""

    def step(log, r):
        log, ok, left = limit_step(log or [], r.ts.timestamp(), limit, seconds)
        return log, (ok, left)

    return by_ranges(df.select("client", "ts", *(["event_id"] if "event_id" in df.columns else [])), step, "allowed boolean, remaining int", most).select("client", "ts", "allowed", "remaining")


def breaker_batch(df: DataFrame, most: int | None = None) -> DataFrame:
    """df: client, ts, ok (and event_id)."""

    def step(s, r):
        s, admitted = breaker_step(s or ("closed", 0, 0, 0.0), r.ts.timestamp(), bool(r.ok))
        return s, (admitted, s[0])

    return by_ranges(df, step, "admitted boolean, state string", most).select("client", "ts", "ok", "admitted", "state")


def budget_batch(df: DataFrame, rpm: int = 30, daily: int = 3, most: int | None = None) -> DataFrame:
    """df: client, ts (and event_id)."""

    def step(s, r):
        t = r.ts.timestamp()
        s, ok = budget_step(s or ([], 0, t), t, rpm, daily)
        return s, (ok,)

    return by_ranges(df, step, "called boolean", most).select("client", "ts", "called")


def _ordered(pdf: pd.DataFrame) -> Iterator[tuple]:
    x = pdf.sort_values(["ts", "event_id"] if "event_id" in pdf else "ts", kind="stable")
    return x.itertuples(index=False)


def machine_stream(df: DataFrame, step: Callable, result: str, silent: float) -> DataFrame:
    """Any of these machines on a stream of (client, ts, ...): ``step(state, row) -> (state, result)``. A client's state
    goes after ``silent`` seconds of event time without a row."""
    more = [x.split()[0] for x in result.split(", ")]
    names = [f.name for f in df.schema.fields]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {result}"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out, rows = pickle.loads(state.get[0]) if state.exists else None, [], pd.concat(list(batches))
        rows = rows.sort_values(["ts", "event_id"] if "event_id" in rows else "ts", kind="stable")
        for r in rows.itertuples(index=False):
            held, got = step(held, r)
            out.append(got)
        state.update((pickle.dumps(held),))
        state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp() * 1000 + silent * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[names].assign(**{c: [x[i] for x in out] for i, c in enumerate(more)})

    return df.withWatermark("ts", "1 day").groupBy("client").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_stream(df: DataFrame) -> DataFrame:
    """df: client, ts, ok. As ``breaker_batch``; a client's state is kept for 30 days, since failures in a row do not expire."""
    return machine_stream(df, lambda s, r: (lambda x: (x[0], (x[1], x[0][0])))(breaker_step(s or ("closed", 0, 0, 0.0), r.ts.timestamp(), bool(r.ok))), "admitted boolean, state string", 30 * 86_400)


def budget_stream(df: DataFrame, rpm: int = 30, daily: int = 3) -> DataFrame:
    """df: client, ts. As ``budget_batch``; a day of silence resets both budgets."""

    def step(s, r):
        t = r.ts.timestamp()
        s, ok = budget_step(s or ([], 0, t), t, rpm, daily)
        return s, (ok,)

    return machine_stream(df, step, "called boolean", 86_400)


def limiter_stream(df: DataFrame, limit: int = 2, seconds: float = 3600.0) -> DataFrame:
    """The same decisions on a stream; a client's state goes once it is silent for a window of event time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        out = []
        for r in _ordered(pd.concat(list(batches))):
            log, ok, left = limit_step(log, r.ts.timestamp(), limit, seconds)
            out.append((r.client, r.ts, ok, left))
        state.update((log,))
        state.setTimeoutTimestamp(max(int(out[-1][1].timestamp() * 1000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "ts", "allowed", "remaining"])

    return df.withWatermark("ts", "1 day").groupBy("client").applyInPandasWithState(run, LIMITER, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there.

    Appended rows go to a parquet folder that all executors share; only the other modes,
    whose results are reports of bounded size, use a table in the driver's memory.
    """
    spark = df.sparkSession
    w = df.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        w.format("memory").start().awaitTermination()
        return spark.table(name)
    root = fresh(spark, name)  # a run never meets an earlier run's state
    w.format("parquet").option("path", root + "/rows").option("checkpointLocation", root + "/state").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(root + "/rows")


def refreshed(df: DataFrame, name: str, every: str = "5 minutes", mode: str = "complete"):
    """A running stream whose result is a table of the session, renewed at each trigger: cached statistics, or a page that polls. The
    caller stops it. For reports of bounded size, as the table lies in the driver's memory."""
    return df.writeStream.queryName(name).outputMode(mode).format("memory").trigger(processingTime=every).start()
