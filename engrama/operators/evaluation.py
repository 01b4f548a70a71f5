"""Retrieval metrics and store health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(hits: DataFrame, queries: DataFrame, k: int, relevant: int) -> DataFrame:
    """One row: MRR, capped recall, precision over k, irrelevant share of hits, characters returned, queries without hits."""
    r = hits.join(queries.select("query_id", "topic"), "query_id").withColumn("hit", F.array_contains("tags", F.col("topic")).cast("int"))
    per = r.groupBy("query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("nth"))).alias("first"), F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    per = queries.select("query_id").join(per, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c, n, d=6: F.round(F.avg(c), d).alias(n)
    return per.agg(
        mean(z(1.0 / F.col("first")), "mrr"), mean(z(F.least(F.lit(1.0), F.col("h") / max(1, relevant))), "recall"), mean(z(F.col("h") / k), "precision_at_k"),
        mean(z((F.col("n") - F.col("h")) / F.col("n")), "irrelevant_rate"), mean(F.coalesce("chars", F.lit(0)), "pack_chars", 3), F.count(F.lit(1)).alias("n_queries"), F.count(F.when(F.col("n").isNull(), 1)).alias("n_zero_hits"),
    )


def schema_health(semantic: DataFrame, now: float, stale_seconds: float) -> DataFrame:
    """One row: schemas, singletons, stale ones, median sources, by topic tags pure, mixed and untagged, and the most of a topic."""
    topics = F.array_distinct(F.filter("tags", lambda t: t.rlike("^topic-[0-9]+$")))
    s = semantic.select(F.size("source_episode_ids").alias("n"), topics.alias("topics"), F.coalesce("last_accessed", "created_at").alias("seen"))
    per_topic = s.select(F.explode("topics").alias("t")).groupBy("t").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_per_topic"))
    n_topics = F.size("topics")
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return s.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("n") <= 1, "singletons"), count(F.lit(float(now)) - F.col("seen") > stale_seconds, "stale"), F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_sources"),
        count(n_topics == 1, "pure"), count(n_topics > 1, "mixed"), count(n_topics == 0, "untagged"),
    ).join(per_topic)


def tool_metrics(calls: DataFrame, window: int = 200) -> DataFrame:
    """Per tool: calls, errors, and nearest-rank p50 and p95 in ms of its last `window` calls."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("tool").orderBy(F.col("seq").desc()))
    last = calls.select("tool", "seq", "seconds").withColumn("_nth", nth).where(F.col("_nth") <= window)
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by seconds) * 1000")
    quantiles = last.groupBy("tool").agg(F.round(p(0.5), 6).alias("p50_ms"), F.round(p(0.95), 6).alias("p95_ms"))
    counts = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("errors"))
    return counts.join(quantiles, "tool")
