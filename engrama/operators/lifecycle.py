"""Strength, forgetting, replay, consolidation and reflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config
from engrama.functions import text as tx
from engrama.functions import vectors as vx
from engrama.operators import clusters
from engrama.operators.nearest import in_grid


def access_times(history: str = "access_history", created: str = "created_at", last: str = "last_accessed", count: str = "retrieval_count") -> Column:
    """The recorded accesses, or what older records allow: created once and last_accessed as often as retrieved."""
    rebuilt = F.concat(F.filter(F.array(created), lambda t: t.isNotNull()), F.when(F.col(last).isNotNull(), F.array_repeat(last, F.coalesce(F.col(count), F.lit(0)))).otherwise(F.array().cast("array<double>")))
    return F.when(F.size(F.coalesce(F.col(history), F.array().cast("array<double>"))) > 0, F.col(history)).otherwise(rebuilt)


def strength(now: float, d: float = DEFAULT.forget_d, times: Column | None = None, salience: str = "salience") -> Column:
    """salience x the sum over accesses of (1 + age)^-d; salience alone without accesses."""
    t = access_times() if times is None else times
    s = F.coalesce(salience, F.lit(0.3))
    total = F.aggregate(t, F.lit(0.0), lambda acc, x: acc + F.pow(1 + F.greatest(F.lit(0.0), F.lit(float(now)) - x), F.lit(-d)))
    return F.when(F.size(t) == 0, s).otherwise(s * total)


def forgettable(episodic: DataFrame, now: float, floor: float = DEFAULT.strength_floor, cfg: Config = DEFAULT) -> DataFrame:
    """Records under the floor once consolidated, under half of it before; adds strength."""
    s = episodic.withColumn("strength", strength(now, cfg.forget_d))
    return s.where(F.col("strength") < F.when(F.col("consolidated_into") != 0, floor).otherwise(floor / 2))


def cold_schemas(semantic: DataFrame, now: float, unused_seconds: float) -> DataFrame:
    """Schemas unused for longer; one without a last_accessed is never cold; 0 or less is off."""
    if unused_seconds <= 0:
        return semantic.where("false")
    return semantic.where(F.col("last_accessed").isNotNull() & (F.lit(float(now)) - F.col("last_accessed") > unused_seconds))


def replay_candidates(episodic: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return episodic.where((F.coalesce("salience", F.lit(0.3)) >= cfg.replay_min_salience) & (F.coalesce("session_id", F.lit("")) != "") & (F.col("consolidated_into") == 0))


def replay_topk(episodic: DataFrame, now: float, cfg: Config = DEFAULT) -> DataFrame:
    """The strongest records: (id, session_id, salience, strength)."""
    s = replay_candidates(episodic, cfg).select("id", "session_id", "salience", strength(now, cfg.forget_d).alias("strength"))
    return s.orderBy(F.col("strength").desc(), "id").limit(cfg.replay_top_k)


def replay_edges(episodic: DataFrame, now: float, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, anchor, target, score): of the top, each session's strongest to its others, by its mean salience."""
    top = replay_topk(episodic, now, cfg)
    group = Window.partitionBy("session_id")
    w = group.orderBy(F.col("strength").desc(), "id")
    t = top.select("*", F.row_number().over(w).alias("r"), F.first("id").over(w).alias("anchor"), F.avg("salience").over(group).alias("mean"), F.count(F.lit(1)).over(group).alias("n"))
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cfg.replay_gain * F.col("mean")))
    return t.where("r > 1 and n > 1").select("session_id", "anchor", F.col("id").alias("target"), gain.alias("score"))


def bump(episodic: DataFrame, bumps: DataFrame, cap: int = DEFAULT.access_history_cap) -> DataFrame:
    """Adds accesses (id, t): newest `cap` kept, last_accessed and retrieval_count moved on."""
    new = bumps.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("_t"))
    j = episodic.join(new, "id", "left")
    history = F.concat(F.coalesce("access_history", F.array().cast("array<double>")), F.coalesce("_t", F.array().cast("array<double>")))
    kept = F.slice(history, F.greatest(F.lit(1), F.size(history) - cap + 1), F.lit(cap))
    return j.withColumns({
        "last_accessed": F.coalesce(F.element_at("_t", -1), F.col("last_accessed")),
        "retrieval_count": F.col("retrieval_count") + F.coalesce(F.when(F.col("_t").isNotNull(), F.size("_t")), F.lit(0)),
        "access_history": F.when(F.col("_t").isNull(), F.col("access_history")).otherwise(kept),
    }).drop("_t")


def drift(episodic: DataFrame, cues: DataFrame, now: float, cfg: Config = DEFAULT) -> DataFrame:
    """Reconsolidation of records by cues(id, score, cue): each moves a little toward its cue.

    A locked record and a score under drift_min_score change nothing; past the window after
    the last touch only the clock is set; at drift_max the record locks.
    """
    j = episodic.join(cues.select("id", "score", "cue"), "id", "left")
    last, total = F.coalesce("last_reconsolidated_at", F.lit(0.0)), F.coalesce("drift_total", F.lit(0.0))
    touched = F.col("score").isNotNull() & ~F.coalesce("drift_locked", F.lit(False)) & (F.col("score") >= cfg.drift_min_score)
    moves = touched & ~((last > 0) & (F.lit(float(now)) - last > cfg.drift_window_seconds))
    step = F.lit(cfg.drift_alpha) * F.col("score")
    return j.withColumns({
        "embedding": F.when(moves & F.col("cue").isNotNull(), vx.blend("embedding", "cue", step).cast("array<float>")).otherwise(F.col("embedding")),
        "drift_total": F.when(moves, total + step).otherwise(F.col("drift_total")), "drift_locked": F.when(moves & (total + step >= cfg.drift_max), True).otherwise(F.col("drift_locked")),
        "last_reconsolidated_at": F.when(touched, float(now)).otherwise(F.col("last_reconsolidated_at")),
    }).select(*episodic.columns)


# consolidation


def cap_candidates(df: DataFrame, cap: int = DEFAULT.max_candidates) -> DataFrame:
    """The most retrieved rows, if there are more than cap."""
    return df.orderBy(F.col("retrieval_count").desc(), "id").limit(cap)


def nearest_schema(candidates: DataFrame, semantic: DataFrame) -> DataFrame:
    """(id, schema, d1, d2): each candidate's nearest schema and the distance of the second; d2 = d1 with one schema.

    Both sides may be large, so their blocks meet in a grid, and two rows a candidate leave a cell.
    """
    near = in_grid(semantic.select("id", "embedding"), candidates.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 2)
    at = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    return near.groupBy(F.col("query_id").alias("id")).agg(at(1, "id").alias("schema"), at(1, "distance").alias("d1"), F.coalesce(at(2, "distance"), at(1, "distance")).alias("d2"))


def replay_score(strength: Column, d1: Column, d2: Column, beta: float = DEFAULT.schema_margin_beta) -> Column:
    return F.greatest(strength * d1 / (1 + beta * F.greatest(F.lit(0.0), d2 - d1)), F.lit(1e-9))


def confidence(n: Column, full_at: int = DEFAULT.confidence_full_at) -> Column:
    return F.least(F.lit(1.0), n / max(1, full_at))


def absorption(candidates: DataFrame, semantic: DataFrame, now: float, cfg: Config = DEFAULT) -> DataFrame:
    """(id, schema, d1, score): candidates near enough to a schema to join it, with the priority they do it in."""
    near = nearest_schema(candidates, semantic).where(F.col("d1") <= cfg.absorb_distance)
    s = candidates.select("id", strength(now, cfg.forget_d).alias("strength"))
    return near.join(s, "id").select("id", "schema", "d1", replay_score(F.col("strength"), F.col("d1"), F.col("d2"), cfg.schema_margin_beta).alias("score"))


def residual(candidates: DataFrame, absorbed: DataFrame) -> DataFrame:
    return candidates.join(absorbed.select("id"), "id", "left_anti")


def merge_into_schema(semantic: DataFrame, absorbed: DataFrame, now: float, cfg: Config = DEFAULT) -> DataFrame:
    """Schemas with new sources: the union, its confidence, and the time; a merge that adds nothing changes nothing."""
    new = absorbed.groupBy("schema").agg(F.collect_set("id").alias("_new"))
    j = semantic.join(new.withColumnRenamed("schema", "id"), "id", "left")
    union = F.array_sort(F.array_union("source_episode_ids", "_new"))
    grows = F.col("_new").isNotNull() & (F.size(union) > F.size("source_episode_ids"))
    return j.withColumns({
        "source_episode_ids": F.when(grows, union).otherwise(F.col("source_episode_ids")), "confidence": F.when(grows, confidence(F.size(union), cfg.confidence_full_at)).otherwise(F.col("confidence")),
        "updated_at": F.when(grows, F.lit(float(now))).otherwise(F.col("updated_at")), "last_accessed": F.when(grows, F.lit(float(now))).otherwise(F.col("last_accessed")),
    }).drop("_new")


def n_clusters(n: int, cap: int = DEFAULT.max_clusters) -> int:
    return max(1, min(int(n**0.5), n, cap))


def kmeans(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """df with a `cluster` by mini-batch k-means on the directions of its embeddings."""
    return clusters.assigned(df, clusters.fit(df, k, seed))


def cluster_heads(members: DataFrame) -> DataFrame:
    """(cluster, id): the most salient member, the first of equals."""
    return members.groupBy("cluster").agg(F.min_by("id", F.struct(-F.col("salience"), F.col("id"))).alias("id"))


def tag_unions(members: DataFrame) -> DataFrame:
    return members.select("cluster", F.explode("tags").alias("t")).groupBy("cluster").agg(F.array_sort(F.collect_set("t")).alias("tags"))


def plurality(members: DataFrame, group: str, value: str) -> DataFrame:
    """(group, winner): the commonest value, null on a tie or without values."""
    counts = members.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(group).agg(F.max("n").alias("n"))
    best = counts.join(top, [group, "n"]).groupBy(group).agg(F.count(F.lit(1)).alias("ties"), F.min(value).alias("v"))
    return members.select(group).distinct().join(best, group, "left").select(group, F.when(F.col("ties") == 1, F.col("v")).alias("winner"))


def gists(members: DataFrame) -> DataFrame:
    """(cluster, gist): the head's first line, and the others' distinct first lines as bullets."""
    line = tx.first_line(F.col("content"))
    rows = members.select("cluster", "id", "salience", line.alias("line"))
    g = rows.groupBy("cluster").agg(F.min_by("line", F.struct(-F.col("salience"), F.col("id"))).alias("head"), F.collect_set("line").alias("lines"))
    leads = F.filter(F.array_sort(F.array_except("lines", F.array("head"))), lambda x: x != "")
    bullets = F.array_join(F.transform(leads, lambda x: F.concat(F.lit("- "), x)), "\n")
    return g.select("cluster", F.when(F.size(leads) > 0, F.concat("head", F.lit("\n\nRelated:\n"), bullets)).otherwise(F.col("head")).alias("gist"))


def age_candidates(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A pass older; over-aged ones go; hits decay to no less than one."""
    out = candidates.withColumn("age", F.col("age") + 1).where(F.col("age") <= cfg.candidate_max_age)
    return out.withColumn("hits", F.greatest(F.lit(1), F.floor(F.col("hits") * (1 - cfg.candidate_hit_decay))).cast("int")) if cfg.candidate_hit_decay > 0 else out


def nearest_candidate(gists: DataFrame, candidates: DataFrame, within: float = DEFAULT.schema_merge_distance) -> DataFrame:
    """(id, candidate, distance): each gist's nearest parked candidate, if near enough."""
    n = nearest_schema(gists, candidates)
    return n.where(F.col("d1") <= within).select("id", F.col("schema").alias("candidate"), F.col("d1").alias("distance"))


def promotion(gists: DataFrame, candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, candidate, decision, hits): park, fast-promote, update or promote each gist (id, embedding, session_id, epoch)."""
    near = gists.select("id", "session_id", "epoch").join(nearest_candidate(gists, candidates, cfg.schema_merge_distance), "id", "left")
    j = near.join(candidates.select(F.col("id").alias("candidate"), "hits", "sessions", "epochs"), "candidate", "left")
    hits = F.col("hits") + 1
    sessions = F.array_distinct(F.concat("sessions", F.filter(F.array("session_id"), lambda s: s.isNotNull())))
    epochs = F.array_distinct(F.concat("epochs", F.array("epoch")))
    diverse = (F.size(sessions) >= cfg.min_hit_sessions) & (F.size(epochs) >= cfg.min_hit_epochs)
    fast = cfg.min_recurrence <= 1 and cfg.min_hit_sessions <= 1 and cfg.min_hit_epochs <= 1
    decision = F.when(F.col("candidate").isNull(), "fast_promote" if fast else "park").when((hits >= cfg.min_recurrence) & diverse, "promote").otherwise("update")
    return j.select("id", "candidate", decision.alias("decision"), F.coalesce(hits, F.lit(1)).cast("int").alias("hits"))


def reflect_recent(episodic: DataFrame, session: str, k: int, cfg: Config = DEFAULT) -> DataFrame:
    """The k last accessed of a session's first max(50, 5k) rows by id; of all its rows with cfg.reflect_newest_first."""
    rows = episodic.where(F.col("session_id") == session)
    if not cfg.reflect_newest_first:
        rows = rows.orderBy("id").limit(max(50, 5 * k))
    return rows.orderBy(F.col("last_accessed").desc(), "id").limit(k)
