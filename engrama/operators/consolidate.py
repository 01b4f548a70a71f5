"""One consolidation pass, the encode path and retiring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config
from engrama.functions import signals as sg
from engrama.functions import text as tx
from engrama.operators import codes
from engrama.operators import lifecycle as lc
from engrama.operators.nearest import in_grid
from engrama.operators.store import next_ids

CANDIDATES = "id long, gist string, embedding array<double>, hits int, age int, sessions array<string>, epochs array<long>"


def empty_candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANDIDATES)


@dataclass
class Pass:
    """decisions: (cluster, decision, target, n, sources, gist); absorbed: (id, schema, d1, score); candidates: the buffer after the pass."""

    decisions: DataFrame
    absorbed: DataFrame
    candidates: DataFrame


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(1 - a @ b / n) if n > 0 else np.inf


def decide(clusters: list[dict], schemas: list[tuple[int, np.ndarray, set]], buffer: list[dict], epoch: int, cfg: Config = DEFAULT) -> tuple[list[tuple], list[dict]]:
    """Stage 2 for the clusters of a pass, in turn: merge, park, update, promote or reject each.

    clusters: cluster, sources, gist, vector, session. Clusters act on each other through
    the buffer, so this is a loop; cfg.max_clusters bounds it.
    """
    out, buffer = [], [dict(b) for b in buffer]
    following = max([b["id"] for b in buffer], default=0) + 1
    for c in clusters:
        n = len(c["sources"])
        add = lambda decision, target=None, c=c, n=n: out.append((int(c["cluster"]), decision, target, n, sorted(c["sources"]), c["gist"]))
        if n < cfg.min_cluster:
            add("skip")
            continue
        near = min(((_distance(c["vector"], v), i, s) for i, v, s in schemas), default=None, key=lambda x: x[:2])
        if near and cfg.schema_merge_distance > 0 and near[0] <= cfg.schema_merge_distance and set(c["sources"]) - near[2]:
            near[2].update(c["sources"])
            add("merge", near[1])
            continue
        if cfg.schema_merge_distance <= 0:
            add("skip")
            continue
        held = min(((_distance(c["vector"], np.asarray(b["embedding"])), b["id"], k) for k, b in enumerate(buffer)), default=None)
        held = held if held and held[0] <= cfg.schema_merge_distance else None
        session = [c["session"]] if c["session"] else []
        if held is None:
            if cfg.min_recurrence <= 1 and cfg.min_hit_sessions <= 1 and cfg.min_hit_epochs <= 1:
                decision = "fast_promote"
            else:
                buffer.append({"id": following, "gist": c["gist"], "embedding": [float(x) for x in c["vector"]], "hits": 1, "age": 0, "sessions": session, "epochs": [epoch]})
                add("park", following)
                following += 1
                continue
        else:
            b = buffer[held[2]]
            b["hits"], b["age"] = b["hits"] + 1, 0
            b["sessions"] = list(dict.fromkeys([*b["sessions"], *session]))
            b["epochs"] = list(dict.fromkeys([*b["epochs"], epoch]))
            if b["hits"] < cfg.min_recurrence or len(b["sessions"]) < cfg.min_hit_sessions or len(b["epochs"]) < cfg.min_hit_epochs:
                add("update", b["id"])
                continue
            buffer.pop(held[2])
            decision = "promote"
        if 0 < cfg.min_schema_size and n < cfg.min_schema_size:
            decision = "reject_size"
        elif min(1.0, n / max(1, cfg.confidence_full_at)) < cfg.min_promotion_confidence:
            decision = "reject_confidence"
        add(decision, held[1] if held else None)
    return out, buffer


def consolidate(candidates: DataFrame, semantic: DataFrame, buffer: DataFrame, epoch: int, now: float, cfg: Config = DEFAULT) -> Pass:
    """Ages the buffer, absorbs what is near a schema, clusters the rest, and decides each cluster."""
    spark = candidates.sparkSession
    decided = "cluster int, decision string, target long, n int, sources array<long>, gist string"
    aged = [r.asDict() for r in lc.age_candidates(buffer, cfg).orderBy("id").collect()]
    candidates = lc.cap_candidates(candidates, cfg.max_candidates).persist()  # max_candidates rows
    n = candidates.count()
    none = Pass(spark.createDataFrame([], decided), spark.createDataFrame([], "id long, schema long, d1 double, score double"), spark.createDataFrame(aged, CANDIDATES))
    if n < cfg.min_cluster:
        return none
    absorbed = lc.absorption(candidates, semantic, now, cfg)
    rest = lc.residual(candidates, absorbed)
    left = rest.count()
    if left < cfg.min_cluster:
        return Pass(none.decisions, absorbed, none.candidates)
    members = lc.kmeans(rest, lc.n_clusters(left, cfg.max_clusters)).persist()
    mean = members.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    joined = members.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("sources")).join(lc.gists(members), "cluster").join(lc.plurality(members, "cluster", "session_id"), "cluster").join(mean, "cluster")
    clusters = [{"cluster": r.cluster, "sources": list(r.sources), "gist": r.gist, "vector": np.array([p.x for p in r.v]), "session": r.winner} for r in joined.orderBy("cluster").collect()]  # max_clusters rows
    near = lc.nearest_schema(members.groupBy("cluster").agg(F.min("id").alias("id")).join(mean, "cluster").select(F.col("cluster").cast("long").alias("id"), F.transform("v", lambda p: p["x"]).alias("embedding")), semantic)
    reach = near.where(F.col("d1") <= cfg.schema_merge_distance).select(F.col("schema").alias("id")).distinct()
    schemas = [(r.id, np.array(r.embedding, dtype=float), set(r.source_episode_ids)) for r in semantic.join(reach, "id", "left_semi").select("id", "embedding", "source_episode_ids").collect()]  # one a cluster at most
    decisions, after = decide(clusters, schemas, aged, epoch, cfg)
    return Pass(spark.createDataFrame(decisions, decided), absorbed, spark.createDataFrame(after, CANDIDATES))


def _earlier(df: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, nth): of each record of asked its k nearest earlier ones in its session, among df."""
    return in_grid(df, asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), "session_id"), k, within="session_id", earlier=True)


def _long(df: DataFrame, cfg: Config) -> DataFrame:
    return df.where(F.length(F.trim("content")) >= cfg.min_dedup_chars)


def dedup_cosine(df: DataFrame, cfg: Config = DEFAULT, asked: DataFrame | None = None) -> DataFrame:
    """(id, match, distance): records within dedup_distance of an earlier one of their session; short ones never. asked: the records that may go, if not all of df."""
    near = _earlier(df, _long(df if asked is None else asked, cfg), 1)
    return near.where(F.col("distance") <= cfg.dedup_distance).select(F.col("query_id").alias("id"), F.col("id").alias("match"), "distance")


def dedup_jaccard(df: DataFrame, cfg: Config = DEFAULT, asked: DataFrame | None = None) -> DataFrame:
    """(id, match, jaccard): of the nearest code_candidates earlier records of the session the one whose sparse code overlaps most, if enough. asked: as in dedup_cosine."""
    asked, df = _long(df if asked is None else asked, cfg), _long(df, cfg)
    near = _earlier(df, asked, cfg.code_candidates).select(F.col("query_id").alias("id"), F.col("id").alias("match"), F.col("nth").alias("r"))
    codes_of = near.join(asked.select("id", "dg_support"), "id").join(df.select(F.col("id").alias("match"), F.col("dg_support").alias("_dg_support")), "match")
    best = codes_of.select("id", "match", "r", codes.jaccard(F.col("dg_support"), F.col("_dg_support")).alias("j")).groupBy("id").agg(F.min(F.struct((-F.col("j")).alias("j"), "r", "match")).alias("b"))
    return best.select("id", F.col("b.match").alias("match"), F.round(-F.col("b.j"), 6).alias("jaccard")).where(F.col("jaccard") >= cfg.code_jaccard)


def surprise(df: DataFrame, cfg: Config = DEFAULT, asked: DataFrame | None = None) -> DataFrame:
    """asked (or df) with more salience where the nearest earlier record of the session is far; none is no surprise."""
    asked = df if asked is None else asked
    near = _earlier(df, asked, 1).select(F.col("query_id").alias("id"), F.col("distance").alias("_d"))
    boosted = F.when(F.col("_d") >= cfg.surprise_floor, F.least(F.lit(1.0), F.col("salience") + cfg.surprise_boost)).otherwise(F.col("salience"))
    return asked.join(near, "id", "left").withColumn("salience", boosted).drop("_d")


def supersede(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """df without the groups of pairs(target, new_group), unless the new record landed in the same group."""
    group = F.coalesce("episode_group_id", "id")
    targets = df.select("id", group.alias("_g")).join(pairs.withColumnRenamed("target", "id"), "id").where("_g <> new_group").select("_g")
    return df.withColumn("_g", group).join(targets, "_g", "left_anti").drop("_g")


def encode(new: DataFrame, existing: DataFrame, loader, now: float, cfg: Config = DEFAULT, prefix: str = "", hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """(inserts, bumps) for new(content, session_id, tags, salience and what else is to stay): signals, embedding, dedup, surprise, segments.

    salience null is derived from the signals. bumps: (id, t, *the columns of new) of records
    that a new one repeats. Only the new rows are looked up; hold keeps a batch of writes that is read several times.
    """
    text = F.col("content")
    found = sg.flags(text)
    refs, length = sg.references(text), sg.length_class(text)
    rows = new.withColumns({**found, "refs": refs, "length_class": length, "salience": F.coalesce("salience", sg.salience(found, refs, length, cfg.salience_base))})
    rows = codes.with_support(codes.embed(rows, "content", loader, prefix, char_cap=cfg.embed_char_cap), cfg)
    rows = hold(next_ids(existing.select("id"), rows, ["session_id", "content"]))
    old = codes.with_missing_support(existing.select("id", "session_id", "content", "embedding", "salience", *[c for c in existing.columns if c == "dg_support"]), cfg)
    every = old.unionByName(rows.select(old.columns))
    repeats = hold(dedup_jaccard(every, cfg, rows))
    bumps = repeats.select("id", "match").join(rows.select("id", *new.columns), "id").select(F.col("match").alias("id"), F.lit(float(now)).alias("t"), *new.columns)
    kept = surprise(every, cfg, rows.select(old.columns)).select("id", "salience").join(rows.drop("salience"), "id").join(repeats.select("id"), "id", "left_anti")
    parts = tx.segments(kept, "id", "content", cfg.segment_max_chars, cfg.segment_max_items)
    sizes = parts.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("segment_count"))
    inserts = kept.drop("content").join(parts.withColumnRenamed("segment", "content"), "id").join(sizes, "id").withColumnRenamed("position", "position_in_episode")
    return inserts.withColumns({"created_at": F.lit(float(now)), "retrieval_count": F.lit(0), "consolidated_into": F.lit(0)}), bumps
