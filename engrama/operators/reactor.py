"""The interaction log's counters and triggers."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config


#: Events with seq in one range of this width are numbered together.
RANGE = 1 << 16


def state(log: DataFrame) -> DataFrame:
    """Per event: novel encodes since the last consolidate, events since the last dream, the previous event's time, and when each last ran.

    Running sums within ranges of seq, which is unique, moved up by what the ranges before
    hold: a row for each range of RANGE events is all that one task sees of the whole log.
    """
    within = Window.partitionBy("_r").orderBy("seq")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    novel = F.when((F.col("kind") == "encode") & ~F.coalesce("deduped", F.lit(False)), 1).otherwise(0)
    at = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    local = log.withColumn("_r", F.floor(F.col("seq") / RANGE)).withColumns({"_n": F.sum(novel).over(upto), "_e": F.sum(F.when(F.col("kind") == "dream", 0).otherwise(1)).over(upto), "_prev": F.lag("ts").over(within)})
    local = local.withColumns({name: F.last(at(kind, c), True).over(upto) for name, kind, c in (("_nc", "consolidate", "_n"), ("_tc", "consolidate", "ts"), ("_ed", "dream", "_e"), ("_td", "dream", "ts"))})
    ends = local.groupBy("_r").agg(F.max("_n").alias("_n"), F.max("_e").alias("_e"), F.max_by("ts", "seq").alias("_ts"), *[F.max_by(c, "seq").alias(c) for c in ("_nc", "_tc", "_ed", "_td")])
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = ends.withColumns({"N": F.coalesce(F.sum("_n").over(before), F.lit(0)), "E": F.coalesce(F.sum("_e").over(before), F.lit(0))})
    carried = ends.select("_r", "N", "E", F.last("_ts").over(before).alias("T"), *[F.last(x, True).over(before).alias(name) for name, x in (("NC", F.col("_nc") + F.col("N")), ("TC", F.col("_tc")), ("ED", F.col("_ed") + F.col("E")), ("TD", F.col("_td")))])
    out = local.join(F.broadcast(carried), "_r").withColumns({
        "novel": F.col("_n") + F.col("N") - F.coalesce(F.col("_nc") + F.col("N"), "NC", F.lit(0)), "since_dream": F.col("_e") + F.col("E") - F.coalesce(F.col("_ed") + F.col("E"), "ED", F.lit(0)),
        "prev_ts": F.coalesce("_prev", "T"), "last_consolidate": F.coalesce("_tc", "TC"), "last_dream": F.coalesce("_td", "TD"),
    })
    return out.select(*log.columns, "novel", "since_dream", "prev_ts", "last_consolidate", "last_dream")


def triggers(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds consolidate_due and dream_due for the counters as they stand."""
    consolidate = (F.col("novel") >= cfg.novel_trigger) & (F.col("ts") - F.coalesce("last_consolidate", F.lit(0.0)) >= cfg.consolidate_cooldown)
    idle = F.coalesce(F.col("ts") - F.col("prev_ts") >= cfg.dream_idle, F.lit(False)) & (F.coalesce("prev_ts", F.lit(0.0)) > 0)
    dream = (F.col("since_dream") > 0) & ((F.col("since_dream") >= cfg.dream_events) | idle)
    return states.withColumns({"consolidate_due": consolidate, "dream_due": dream})


@dataclass
class Counters:
    """What a reactor remembers between events."""

    novel: int = 0
    since_dream: int = 0
    last: float = 0.0
    last_consolidate: float = 0.0
    last_dream: float = 0.0

    def take(self, ts: float, kind: str, deduped: bool | None, cfg: Config = DEFAULT) -> list[str]:
        """Folds an event in and returns the triggers that fire; firing resets their counters at once."""
        prev, self.last = self.last, ts
        self.since_dream += 1
        if kind == "encode" and not deduped:
            self.novel += 1
        elif kind == "consolidate":
            self.last_consolidate, self.novel = ts, 0
        elif kind == "dream":
            self.last_dream, self.since_dream = ts, 0
        fired = []
        if kind in ("consolidate", "dream"):
            return fired
        if self.novel >= cfg.novel_trigger and ts - self.last_consolidate >= cfg.consolidate_cooldown:
            fired.append("consolidate")
            self.novel, self.last_consolidate = 0, ts
        if self.since_dream > 0 and (self.since_dream >= cfg.dream_events or (prev > 0 and ts - prev >= cfg.dream_idle)):
            fired.append("dream")
            self.since_dream, self.last_dream = 0, ts
        return fired


def simulate(log: DataFrame, cfg: Config = DEFAULT, store: str | None = None) -> DataFrame:
    """(store, seq, ts, trigger): what fires along the log. Firing changes what follows, so a store's log folds in order; stores in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counters, out = Counters(), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            out += [(r.store, r.seq, r.ts, t) for t in counters.take(r.ts, r.kind, None if pd.isna(r.deduped) else bool(r.deduped), cfg)]
        return pd.DataFrame(out, columns=["store", "seq", "ts", "trigger"])

    keyed = log.select((F.col(store) if store else F.lit("all")).alias("store"), "seq", "ts", "kind", "deduped")
    return keyed.groupBy("store").applyInPandas(run, "store string, seq long, ts double, trigger string")


def idle_sessions(log: DataFrame, gap_seconds: float, by: str = "session_id") -> DataFrame:
    """(by, started, ended, events): bursts that idle gaps separate."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    starts = F.when(F.coalesce(F.col("ts") - F.lag("ts").over(w) >= gap_seconds, F.lit(True)), 1).otherwise(0)
    bursts = log.select(by, "seq", "ts", starts.alias("s")).select(by, "ts", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("burst"))
    return bursts.groupBy(by, "burst").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events")).drop("burst")
