"""Folds in event time: rows wait in state until the watermark has passed them, then fold in order; late ones come out beside.

The older twins in `state` take events as the source brings them. Here a key's events may
come in any order and any micro-batch within the allowed lateness: they wait in list state,
an event-time timer fires when the watermark has passed them, and they fold by (t, seq), so a
stream gives what the batch operator gives. An event that is older than the watermark when it
comes cannot be folded any more; it leaves at once in a row with `late` set, with the key's
count of such events so far, and nothing is lost in silence. What a fold keeps goes by itself
`keep_seconds` of event time after the key's last event.

State needs the RocksDB provider: `session_settings` has what to set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from engrama.config import DEFAULT, Config
from engrama.operators.consolidate import decide

session_settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
YEAR = 365 * 86_400.0


class Ordered(StatefulProcessor):
    """One key's events in event time. Subclasses say what is kept and what a step gives."""

    #: Columns of an event beside the key; t and seq are among them. Columns of an output row beside key, late and n_late.
    event, result = "seq long, t double", "seq long, t double"

    def __init__(self, cfg: Config = DEFAULT, keep_seconds: float = YEAR):
        self.cfg, self.keep_seconds = cfg, keep_seconds

    def keep(self, handle: StatefulProcessorHandle) -> None:
        """Declares the fold's state."""

    def step(self, key: tuple, e: Any) -> Iterator[tuple]:
        """Folds one event in; gives rows of `result`."""
        raise NotImplementedError

    def passed(self, key: tuple, watermark: float) -> Iterator[tuple]:
        """Rows that are due because event time has come so far, in seconds."""
        return iter(())

    def wake(self, t: float) -> float | None:
        """Event time, beside t itself, at which `passed` has to be asked after an event at t."""
        return None

    def forget(self) -> None:
        """Lets go of what the fold keeps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.event.split(", ")]
        self.whole = [c.split()[1] == "long" for c in self.event.split(", ")]
        self.waiting = handle.getListState("waiting", self.event)
        self.clock = handle.getValueState("clock", "last double, n_late long")
        self.keep(handle)

    @staticmethod
    def _value(v: Any, whole: bool) -> Any:
        """A value of a column as state takes it; columns of longs with nulls come as floats."""
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return int(v) if whole else v.tolist() if hasattr(v, "tolist") else v

    def _clock(self) -> tuple[float, int]:
        return tuple(self.clock.get()) if self.clock.exists() else (-math.inf, 0)

    def _rows(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        n = self._clock()[1]
        return pd.DataFrame([(*key, late, n, *r) for r in rows])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        last, n_late = self._clock()
        fresh, late, blank = [], [], [None] * (len(self.result.split(", ")) - 2)
        for pdf in rows:
            for e in pdf[self.names].itertuples(index=False, name="Event"):
                if e.t < watermark:
                    late.append((int(e.seq), float(e.t), *blank))
                else:
                    fresh.append(tuple(self._value(v, whole) for v, whole in zip(e, self.whole, strict=True)))
        at = self.names.index("t")
        times = {float(e[at]) for e in fresh}
        if fresh:
            self.waiting.appendList(fresh)
        self.clock.update((max([last, *times]), n_late + len(late)))
        for t in times:
            for moment in (t, self.wake(t), t + self.keep_seconds):
                if moment is not None and moment < 9e12:
                    self.handle.registerTimer(math.floor(moment * 1000) + 1)
        if late:
            yield self._rows(key, late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        at, nth = self.names.index("t"), self.names.index("seq")
        held = [tuple(self._value(v, whole) for v, whole in zip(e, self.whole, strict=True)) for e in self.waiting.get()]
        due = sorted((e for e in held if e[at] < watermark), key=lambda e: (e[at], e[nth]))
        out: list[tuple] = []
        if due:
            rest = [e for e in held if e[at] >= watermark]
            self.waiting.put(rest) if rest else self.waiting.clear()
            events = pd.DataFrame(due, columns=self.names, dtype=object)
            for e in events.itertuples(index=False, name="Event"):
                out += self.step(key, e)
        out += self.passed(key, watermark)
        if out:
            yield self._rows(key, out, False)
        last, n_late = self._clock()
        if last + self.keep_seconds < watermark and len(due) == len(held):
            self.forget()
            self.clock.update((-math.inf, n_late))

    def close(self) -> None:
        pass


class Sessions(Ordered):
    """Bursts of a key that idle gaps separate; a burst comes out when event time has passed its gap."""

    result = "seq long, t double, started double, ended double, events long"

    def __init__(self, gap_seconds: float, cfg: Config = DEFAULT, keep_seconds: float = YEAR):
        super().__init__(cfg, keep_seconds)
        self.gap = gap_seconds

    def keep(self, handle):
        self.open = handle.getValueState("open", "started double, ended double, events long, seq long")

    def wake(self, t):
        return t + self.gap

    def step(self, key, e):
        kept = tuple(self.open.get()) if self.open.exists() else None
        if kept and e.t - kept[1] >= self.gap:
            yield kept[3], kept[1], *kept[:3]
            kept = None
        started, _, n, _ = kept or (e.t, e.t, 0, e.seq)
        self.open.update((float(started), float(e.t), int(n) + 1, int(e.seq)))

    def passed(self, key, watermark):
        if self.open.exists():
            started, ended, n, seq = self.open.get()
            if ended + self.gap <= watermark:
                yield seq, ended, started, ended, n
                self.open.clear()

    def forget(self):
        self.open.clear()


class Drift(Ordered):
    """A record's reconsolidation, one row after each touch (T-07)."""

    event, result = "seq long, t double, score double", "seq long, t double, drift_total double, drift_locked boolean, last double"

    def keep(self, handle):
        self.state = handle.getValueState("drift", "total double, locked boolean, last double")

    def step(self, key, e):
        cfg = self.cfg
        total, locked, last = self.state.get() if self.state.exists() else (0.0, False, 0.0)
        if not locked and e.score is not None and e.score >= cfg.drift_min_score:
            if not (last > 0 and e.t - last > cfg.drift_window_seconds):
                total += cfg.drift_alpha * e.score
                locked = total >= cfg.drift_max
            last = e.t
        self.state.update((float(total), bool(locked), float(last)))
        yield e.seq, e.t, total, locked, last

    def forget(self):
        self.state.clear()


class Accesses(Ordered):
    """A record's newest access times, in list state, and its count of them, one row after each access (T-09)."""

    result = "seq long, t double, last_accessed double, retrieval_count long, access_history array<double>"

    def keep(self, handle):
        self.times = handle.getListState("times", "t double")
        self.count = handle.getValueState("count", "n long")

    def step(self, key, e):
        times = [*[r[0] for r in self.times.get()], float(e.t)][-self.cfg.access_history_cap :]
        n = (self.count.get()[0] if self.count.exists() else 0) + 1
        self.times.put([(t,) for t in times])
        self.count.update((int(n),))
        yield e.seq, e.t, times[-1], n, times

    def forget(self):
        self.times.clear()
        self.count.clear()


class Candidates(Ordered):
    """A store's parked candidates, in map state, over its passes (T-08): the clusters of a pass meet the buffer in turn.

    Events: a cluster of a pass, with t the pass's time; passes of a store have distinct times. A pass begins, and its
    candidates age, with its first cluster.
    """

    event = "seq long, t double, epoch long, gist string, vector array<double>, session string, sources array<long>"
    result = "seq long, t double, decision string, target long, hits long"
    buffered = "gist string, embedding array<double>, hits int, age int, sessions array<string>, epochs array<long>"

    def keep(self, handle):
        self.buffer = handle.getMapState("buffer", "id long", self.buffered)
        self.epoch = handle.getValueState("epoch", "epoch long, next long")

    def step(self, key, e):
        names = ["id", *[c.split()[0] for c in self.buffered.split(", ")]]
        before = {k[0]: dict(zip(names, (k[0], *v), strict=True)) for k, v in self.buffer.iterator()}
        epoch, following = self.epoch.get() if self.epoch.exists() else (None, 1)
        held = aged(list(before.values()), self.cfg) if e.epoch != epoch else list(before.values())
        cluster = {"cluster": 0, "sources": list(e.sources), "gist": e.gist, "vector": pd.Series(e.vector, dtype=float).to_numpy(), "session": e.session}
        made, after = decide([cluster], [], sorted(held, key=lambda b: b["id"]), int(e.epoch), self.cfg)
        _, decision, target, n, *_ = made[0]
        if decision == "park":  # ids are not given again, also when the buffer has become empty
            after[-1]["id"] = target = max(target, following)
            following = target + 1
        kept = {b["id"]: b for b in after}
        for i in before.keys() - kept.keys():
            self.buffer.removeKey((i,))
        for i, b in kept.items():
            self.buffer.updateValue((i,), (b["gist"], [float(x) for x in b["embedding"]], int(b["hits"]), int(b["age"]), list(b["sessions"]), [int(x) for x in b["epochs"]]))
        self.epoch.update((int(e.epoch), int(following)))
        yield e.seq, e.t, decision, target, kept[target]["hits"] if target in kept else None

    def forget(self):
        self.buffer.clear()


def aged(buffer: list[dict], cfg: Config = DEFAULT) -> list[dict]:
    """A pass older, as lifecycle.age_candidates."""
    out = [b | {"age": b["age"] + 1} for b in buffer if b["age"] + 1 <= cfg.candidate_max_age]
    return [b | {"hits": max(1, math.floor(b["hits"] * (1 - cfg.candidate_hit_decay)))} for b in out] if cfg.candidate_hit_decay > 0 else out


class Dreams(Ordered):
    """A store's plasticity edges, in map state: touches strengthen one, a dream decays the `budget` stalest and prunes (T-10).

    Events: a touch has src_id and dst_id, a dream has neither. A dream gives a row for each edge that it visits.
    """

    event = "seq long, t double, src_id long, dst_id long, score double"
    result = "seq long, t double, src_id long, dst_id long, weight double, bonus double, pruned boolean"

    def __init__(self, budget: int, cfg: Config = DEFAULT, keep_seconds: float = YEAR):
        super().__init__(cfg, keep_seconds)
        self.budget = budget

    def keep(self, handle):
        self.edges = handle.getMapState("edges", "src_id long, dst_id long", "weight double, bonus double, hits long, inside int, set_at double, last_touch double")

    def step(self, key, e):
        cfg = self.cfg
        if e.src_id is not None:
            edge = (int(e.src_id), int(e.dst_id))
            weight, bonus, hits, inside, at, _ = self.edges.getValue(edge) if self.edges.containsKey(edge) else (0.0, 0.0, 0, 0, None, 0.0)
            elapsed = math.inf if at is None else max(0.0, e.t - at)
            bonus = 0.0 if at is None else bonus * math.exp(-elapsed / cfg.e_ltp_seconds)
            inside = inside + 1 if elapsed <= cfg.e_ltp_seconds else 1
            score = min(1.0, max(0.0, e.score)) if e.score is not None and math.isfinite(e.score) else 0.0
            bonus += 0.5 * score * (cfg.habit_savings if hits >= cfg.habit_hits else 1.0)
            if inside >= cfg.l_ltp_hits:
                weight, bonus, inside = weight + bonus, 0.0, 0
            self.edges.updateValue(edge, (float(weight), float(bonus), int(hits) + 1, int(inside), float(e.t), float(e.t)))
            return
        stalest = sorted(((v[5], *k) for k, v in self.edges.iterator()))[: self.budget]
        for touched, src, dst in stalest:
            weight, bonus, hits, inside, at, _ = self.edges.getValue((src, dst))
            habit, idle = hits >= cfg.habit_hits, max(0.0, e.t - touched)
            weight *= (1 - cfg.ltd_per_day * (cfg.habit_multiplier if habit else 1)) ** (idle * cfg.time_compression / 86_400.0)
            bonus *= math.exp(-idle / cfg.e_ltp_seconds)
            pruned = weight + bonus < cfg.prune_floor and not habit
            if pruned:
                self.edges.removeKey((src, dst))
            else:
                self.edges.updateValue((src, dst), (float(weight), float(bonus), int(hits), int(inside), float(e.t) if cfg.ltd_advance_clock else at, float(e.t) if cfg.ltd_advance_clock else float(touched)))
            yield e.seq, e.t, src, dst, weight, bonus, pruned

    def forget(self):
        self.edges.clear()


def folded(events: DataFrame, by: str, fold: Ordered, late: str = "10 minutes") -> DataFrame:
    """(by, late, n_late, *fold.result) of a stream of events: the fold's rows, and those of events that came more than `late` behind.

    n_late: how many of the key's events have come late so far.
    """
    timed = events.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", late)
    # without the time column nothing is dropped on the way; the fold looks at the watermark itself
    rows = timed.select(F.col(by), *[F.col(c.split()[0]) for c in fold.event.split(", ")])
    kind = events.schema[by].dataType.simpleString()
    schema = StructType.fromDDL(f"{by} {kind}, late boolean, n_late long, {fold.result}")
    return rows.groupBy(by).transformWithStateInPandas(fold, schema, "append", "EventTime")


def windows(log: DataFrame, gap_seconds: float, by: str = "session_id", late: str = "10 minutes") -> DataFrame:
    """(by, started, ended, events) of a stream by Spark's own session windows, which drop what comes too late; `Sessions` keeps it."""
    timed = log.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", late)
    burst = timed.groupBy(F.session_window("_at", f"{int(gap_seconds * 1_000_000)} microseconds"), by)
    return burst.agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count(F.lit(1)).alias("events")).select(by, "started", "ended", "events")
