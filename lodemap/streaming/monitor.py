"""Stateful monitors: context budget warnings, stuck-loop detection, hash gates and a result cache.

On streams, each key's state lives as long as ``keep`` of event time after its last row: a later row of the key starts
anew, and once the watermark has passed, the state goes. So the state follows the keys in use, not all keys ever seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WARNING, CRITICAL, EVERY, STALE = 35, 25, 5, 60
LEVELS = ("ok", "warning", "critical")


def level_of(remaining: float) -> str:
    return "critical" if remaining <= CRITICAL else "warning" if remaining <= WARNING else "ok"


def step(calls: int, last: str, remaining: float, age: float) -> tuple[int, str, bool]:
    """(calls since a message, its level, whether to speak now): the first warning, every fifth after it, and any escalation speaks."""
    if age > STALE:
        return calls, last, False
    level = level_of(remaining)
    if level == "ok":
        return 0, "ok", False
    if last == "ok" or LEVELS.index(level) > LEVELS.index(last) or calls + 1 >= EVERY:
        return 0, level, True
    return calls + 1, last, False


Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]


def _seconds(interval: str) -> float:
    """Length of a plain interval such as ``90 seconds`` or ``30 days``."""
    return pd.Timedelta(interval).total_seconds()


def kept_state(stream: DataFrame, key: str, fields: list[str], step_: Step, state: str, out: str, keep: str, late: str) -> DataFrame:
    """Rows ``out`` that ``step_`` (state or None, row) -> (state, row or None) makes of each key's rows in the order of ``fields``, of which the first is ``ts``.

    ``keep`` bounds the state in event time; rows later than ``late`` behind the newest are passed over.
    """
    names = [x.split()[0] for x in out.split(", ")]
    alive = _seconds(keep)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, seen = (tuple(held.get)[:-1], held.get[-1]) if held.exists else (None, 0.0)
        made = []
        rows = pd.concat(list(frames)).sort_values(fields)
        for row in rows[fields].itertuples(index=False, name=None):
            at = row[0].timestamp()
            now, said = step_(None if now is None or at - seen > alive else now, row)
            seen = at
            if said is not None:
                made.append((keys[0], *said))
        held.update((*now, seen))
        held.setTimeoutTimestamp(max(int((seen + alive) * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=names)

    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, *fields)
    return rows.groupBy(key).applyInPandasWithState(run, out, f"{state}, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def _alert(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
    ts, remaining, age = row
    calls, last, speak = step(*(state or (0, "ok")), remaining, age)
    return (calls, last), (ts, last, remaining) if speak else None


def context_alerts(usage: DataFrame, keep: str = "30 days", late: str = "1 hour") -> DataFrame:
    """session, ts, level, remaining of a stream of (session, ts, remaining percent, age in seconds)."""
    return kept_state(usage, "session", ["ts", "remaining", "age"], _alert, "calls int, last string", "session string, ts timestamp, level string, remaining double", keep, late)


def cached_stream(results: DataFrame, keep: str = "2 minutes", late: str = "1 minute") -> DataFrame:
    """key, ts, result, hit of a stream of (key, ts, result): within ``keep`` of a key's stored result that one is given, else the row's own is stored."""
    alive = _seconds(keep)

    def look(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        ts, result = row
        at = ts.timestamp()
        if state is not None and at - state[1] <= alive:
            return state, (ts, state[0], True)
        return (result, at), (ts, result, False)

    kind = dict(results.dtypes)["result"]
    return kept_state(results, "key", ["ts", "result"], look, f"result {kind}, stored double", f"key {dict(results.dtypes)['key']}, ts timestamp, result {kind}, hit boolean", keep, late)


def stuck_errors(attempts: DataFrame, limit: int = 3, keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """loop, ts, error, times of a stream of attempts (loop, ts, error): each attempt from the ``limit``-th in a row that ends with the same error on. An attempt without an error (null) ends a row."""

    def look(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        ts, error = row
        if error is None or error != error or error == "":
            return ("", 0), None
        last, times = state or ("", 0)
        times = times + 1 if error == last else 1
        return (error, times), (ts, error, times) if times >= limit else None

    return kept_state(attempts, "loop", ["ts", "error"], look, "error string, times int", f"loop {dict(attempts.dtypes)['loop']}, ts timestamp, error string, times int", keep, late)


def stuck_patches(patches: DataFrame, limit: int = 3) -> DataFrame:
    """loop, fingerprint, times of patches whose changed lines came ``limit`` times; works on batches and streams."""
    changed = F.filter(F.split("patch", "\n"), lambda x: x.rlike(r"^[+-](?![+-])"))
    normal = F.array_join(F.transform(changed, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), "\n")
    marked = patches.withColumn("fingerprint", F.substring(F.sha2(normal.cast("binary"), 256), 1, 16))
    return marked.groupBy("loop", "fingerprint").agg(F.count("*").alias("times")).where(F.col("times") >= limit)


def _gate(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
    return (row[1],), row if state is None or state[0] != row[1] else None


def changed_services(manifests: DataFrame, keep: str = "90 days", late: str = "1 hour") -> DataFrame:
    """service, ts, hash of the manifests (service, ts, text) that differ from the one synced last for their service.

    A service that goes back to an older manifest is synced again; so is, on a stream, one that was silent for ``keep``.
    """
    hashed = manifests.select("service", "ts", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("hash"))
    if hashed.isStreaming:
        kind = dict(manifests.dtypes)["service"]
        return kept_state(hashed, "service", ["ts", "hash"], _gate, "last string", f"service {kind}, ts timestamp, hash string", keep, late)
    before = F.lag("hash").over(Window.partitionBy("service").orderBy("ts", "hash"))
    return hashed.withColumn("_last", before).where("_last is null or hash <> _last").drop("_last")
