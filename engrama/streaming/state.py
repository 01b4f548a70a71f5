"""Streaming twins of the stateful folds: same results as the batch operators, event by event.

State lives in Spark's state store by key, so a query restarts from its checkpoint. Within
a micro-batch a key's events are put in order by (t, seq); across batches the source's
order counts, as in the batch folds. Late events are the source's matter: `windows` shows
the watermark policy for aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from engrama.config import DEFAULT, Config
from engrama.operators.reactor import Counters


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames).sort_values(by, kind="stable") if frames else pd.DataFrame()


def reactor(log: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(store, seq, ts, trigger) of a stream of (store, seq, ts, kind, deduped)."""

    def run(key, batches, state):
        c = Counters(*state.get) if state.exists else Counters()
        out = []
        for r in _ordered(batches, ["seq"]).itertuples(index=False):
            out += [(key[0], r.seq, r.ts, t) for t in c.take(r.ts, r.kind, None if pd.isna(r.deduped) else bool(r.deduped), cfg)]
        state.update((int(c.novel), int(c.since_dream), float(c.last), float(c.last_consolidate), float(c.last_dream)))
        yield pd.DataFrame(out, columns=["store", "seq", "ts", "trigger"])

    schema = "store string, seq long, ts double, trigger string"
    kept = "novel long, since_dream long, last double, last_consolidate double, last_dream double"
    return log.groupBy("store").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.NoTimeout)


def co_access(accesses: DataFrame, window: float = DEFAULT.sr_window_seconds) -> DataFrame:
    """(store, src, dst, seq) for each access after others within the window, of a stream of (store, seq, ep_id, t)."""

    def run(key, batches, state):
        recent = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for r in _ordered(batches, ["seq"]).itertuples(index=False):
            recent = [p for p in recent if p[1] >= r.t - window]
            out += [(key[0], p[0], r.ep_id, r.seq) for p in recent if p[0] != r.ep_id]
            recent.append((int(r.ep_id), float(r.t)))
        state.update(([p[0] for p in recent], [p[1] for p in recent]))
        yield pd.DataFrame(out, columns=["store", "src", "dst", "seq"])

    return accesses.groupBy("store").applyInPandasWithState(run, "store string, src long, dst long, seq long", "ids array<long>, times array<double>", "append", GroupStateTimeout.NoTimeout)


def plasticity(reinforcements: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each edge's state after each micro-batch that touches it, of a stream of (src_id, dst_id, seq, score, t)."""
    import math

    def run(key, batches, state):
        weight, bonus, hits, inside, at = state.get if state.exists else (0.0, 0.0, 0, 0, -1.0)
        for r in _ordered(batches, ["t", "seq"]).itertuples(index=False):
            elapsed = max(0.0, r.t - at) if hits else math.inf
            bonus = bonus * math.exp(-elapsed / cfg.e_ltp_seconds) if math.isfinite(elapsed) else bonus
            inside = inside + 1 if elapsed <= cfg.e_ltp_seconds else 1
            score = min(1.0, max(0.0, r.score)) if r.score is not None and math.isfinite(r.score) else 0.0
            bonus += 0.5 * score * (cfg.habit_savings if hits >= cfg.habit_hits else 1.0)
            if inside >= cfg.l_ltp_hits:
                weight, bonus, inside = weight + bonus, 0.0, 0
            hits, at = hits + 1, float(r.t)
        state.update((float(weight), float(bonus), int(hits), int(inside), float(at)))
        yield pd.DataFrame([(*key, weight, bonus, hits, inside, at)], columns=["src_id", "dst_id", "weight", "bonus", "hits", "hits_in_window", "bonus_set_at"])

    schema = "src_id long, dst_id long, weight double, bonus double, hits long, hits_in_window int, bonus_set_at double"
    kept = "weight double, bonus double, hits long, inside int, at double"
    return reinforcements.where("src_id <> dst_id").groupBy("src_id", "dst_id").applyInPandasWithState(run, schema, kept, "update", GroupStateTimeout.NoTimeout)


def windows(log: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows of event time; what comes later than `late` is dropped."""
    timed = log.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def run_reactions(log: DataFrame, handlers: dict, checkpoint: str, cfg: Config = DEFAULT):
    """Starts a query that calls handlers[trigger](batch of fired events) for each micro-batch."""

    def each(batch: DataFrame, _: int) -> None:
        for trigger, handler in handlers.items():
            fired = batch.where(F.col("trigger") == trigger)
            if not fired.isEmpty():
                handler(fired)

    return reactor(log, cfg).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()
