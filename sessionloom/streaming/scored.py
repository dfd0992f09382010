"""Closed sessions of a stream with interval statistics and score, on keyed list and map state.

State per key: the running session (start, last instant, count), a map entry per distinct interval of it, and a list of the instants whose place in
the order is still open. A batch appends its instants to the list and sets one timer, for the first of them. When the watermark passes an instant, the timer folds all
instants behind it into the session at once; the intervals of a session that opens and closes among them never become state. The next
timer is that of the first instant left or of the session's end. Only the instants ahead of the watermark are ever rewritten, so a long session costs no more per
event than a short one, and a key's batch takes a few state calls however many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionloom.functions import columns as C
from sessionloom.operators.enrich import behavioural_proxies, with_score
from sessionloom.session import ship_by_value
from sessionloom.streaming.sessions import INTERVAL_OUTPUT, interval_statistics

ship_by_value(__name__)

#: Map state needs the engine's embedded key-value store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IntervalSessions(StatefulProcessor):
    """Sessions of one key; see the module's text."""

    def __init__(self, keys: list[str], gap_us: int):
        self.keys, self.gap = keys, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "start long, last long, n long")
        self.intervals = handle.getMapState("intervals", "us long", "n long")
        self.pending = handle.getListState("pending", "us long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for frame in rows:
            for us in frame["us"].tolist():
                new[us] = new.get(us, 0) + 1
        # instants before the last folded one are late: their place in the order is gone
        since = self.running.get()[1] if self.running.exists() else None
        kept = [(us, n) for us, n in new.items() if since is None or us >= since]
        if kept:
            self.pending.appendList(kept)
            self._wake(min(us for us, _ in kept))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer of a batch settles all that the watermark has passed; a second one finds nothing left
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed: dict[int, int] = {}
        ahead = []
        for us, n in self.pending.get():
            if us <= mark:
                passed[us] = passed.get(us, 0) + n
            else:
                ahead.append((us, n))
        running = self.running.get() if self.running.exists() else None
        found: dict[int, int] = {}
        closed = []
        # whether intervals of the running session lie in the state
        stored = running is not None
        for us in sorted(passed):
            if running is not None and us - running[1] > self.gap:
                closed.append(self._closed(key, running, found, stored))
                running, found, stored = None, {}, False
            start, last, count = running or (us, us, 0)
            found[us - last] = found.get(us - last, 0) + 1
            if passed[us] > 1:
                found[0] = found.get(0, 0) + passed[us] - 1
            running = (start, us, count + passed[us])
        if running is not None and running[1] + self.gap <= mark:
            closed.append(self._closed(key, running, found, stored))
            running, found, stored = None, {}, False
            self.running.clear()
        if passed:
            if ahead:
                self.pending.put(ahead)
            else:
                self.pending.clear()
            if running is not None:
                self.running.update(running)
                for interval, n in found.items():
                    held = self.intervals.getValue((interval,))[0] if stored and self.intervals.containsKey((interval,)) else 0
                    self.intervals.updateValue((interval,), (held + n,))
        if ahead:
            self._wake(min(us for us, _ in ahead))
        if running is not None:
            self._wake(running[1] + self.gap)
        if closed:
            out = pd.DataFrame(closed, columns=[*self.keys, "session_start", "session_end", "click_count", "click_interval_mean", "click_interval_std", "click_interval_entropy"])
            yield out.assign(**{c: pd.to_datetime(out[c], unit="us") for c in ("session_start", "session_end")})

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def _closed(self, key, running: tuple[int, int, int], found: dict[int, int], stored: bool) -> tuple:
        """The row of a session, of whose intervals some may lie in the state, which is emptied."""
        if stored:
            for (interval,), (n,) in self.intervals.iterator():
                found[interval] = found.get(interval, 0) + n
            self.intervals.clear()
        met = np.array(sorted(found.items()), dtype=float)
        return (*key, *running, *interval_statistics(met[:, 0], met[:, 1]))

    def close(self) -> None:
        pass


def scored_sessions(clicks: DataFrame, keys: list[str], gap_us: int, delay: str = "10 minutes", time: str = "click_time") -> DataFrame:
    """Closed sessions with interval mean, deviation and entropy, rates, behaviour columns and ``bot_likelihood_score``.

    Rows behind the watermark are dropped, as in every stateful operator. The device is part of the key, so its entropy is zero.
    Sets the session's state store to the embedded one, which map state needs.
    """
    clicks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = {f.name: f.dataType.simpleString() for f in clicks.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + INTERVAL_OUTPUT
    marked = clicks.withWatermark(time, delay).select(*keys, time, F.unix_micros(time).alias("us"))
    closed = marked.groupBy(*keys).transformWithStateInPandas(IntervalSessions(keys, gap_us), schema, "append", "eventTime")
    seconds = C.clip(C.seconds_between(F.col("session_end"), F.col("session_start")), low=1.0)
    out = closed.withColumn("session_duration_sec", seconds)
    rate = C.per_minute(F.col("click_count"), F.col("session_duration_sec"))
    std = F.coalesce("click_interval_std", F.lit(0.0))
    idle = C.clip(std / (F.col("session_duration_sec") + 1e-6), 0.0, 1.0)
    out = out.withColumns({"requests_per_minute": rate, "clicks_per_minute": rate, "request_interval_std": std, "session_idle_ratio": idle, "device_entropy": F.lit(0.0)})
    return with_score(behavioural_proxies(out))
