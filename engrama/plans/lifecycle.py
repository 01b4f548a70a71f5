"""Strength, forgetting, replay, consolidation, reflection and their state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrama.config import Config
from engrama.operators import codes, filters
from engrama.operators import consolidate as cs
from engrama.operators import evaluation as ev
from engrama.operators import lifecycle as lc
from engrama.operators import recall as rc
from engrama.sources import tables as T

from .registry import query

NOW = T.NOW
_S = f"salience * list_sum(list_transform(access_history, lambda x: pow(1 + greatest(0, {NOW} - x), -0.2)))"
#: Distances that select something on nearly orthogonal fixtures.
NEAR = Config(absorb_distance=0.75, schema_merge_distance=0.72)


def _r(c):
    return F.round(c, 6).alias(c)


@query("memory_strength", f"SELECT id, round({_S}, 6) AS strength FROM episodic")
def memory_strength(spark, sf):
    return T.episodic(spark, sf).select("id", F.round(lc.strength(NOW), 6).alias("strength"))


@query("forget_candidates", f"SELECT id, round(s, 6) AS strength FROM (SELECT *, {_S} AS s FROM episodic) WHERE s < CASE WHEN consolidated_into <> 0 THEN 0.06 ELSE 0.03 END")
def forget_candidates(spark, sf):
    return lc.forgettable(T.episodic(spark, sf), NOW, 0.06).select("id", _r("strength"))


@query("cold_schemas", f"SELECT id FROM semantic WHERE last_accessed IS NOT NULL AND {NOW} - last_accessed > 5000000")
def cold_schemas(spark, sf):
    return lc.cold_schemas(T.semantic(spark, sf), NOW, 5_000_000).select("id")


@query("replay_candidates", "SELECT id, session_id FROM episodic WHERE salience >= 0.3 AND session_id <> '' AND consolidated_into = 0")
def replay_candidates(spark, sf):
    return lc.replay_candidates(T.episodic(spark, sf)).select("id", "session_id")


TOP_SQL = f"top AS (SELECT id, session_id, salience, {_S} AS strength FROM episodic WHERE salience >= 0.3 AND session_id <> '' AND consolidated_into = 0 ORDER BY 4 DESC, id LIMIT 64)"
_REPLAY = Config(replay_top_k=64)


@query("replay_topk", f"{TOP_SQL} SELECT id, session_id, round(strength, 6) AS strength FROM top")
def replay_topk(spark, sf):
    return lc.replay_topk(T.episodic(spark, sf), NOW, _REPLAY).select("id", "session_id", _r("strength"))


@query("replay_edges", f"""{TOP_SQL}, g AS (SELECT *, row_number() OVER w AS r, first_value(id) OVER w AS anchor, avg(salience) OVER (PARTITION BY session_id) AS mean FROM top WINDOW w AS (PARTITION BY session_id ORDER BY strength DESC, id))
    SELECT session_id, anchor, id AS target, round(least(1, 0.3 * mean), 6) AS score FROM g WHERE r > 1""")
def replay_edges(spark, sf):
    return lc.replay_edges(T.episodic(spark, sf), NOW, _REPLAY).select("session_id", "anchor", "target", _r("score"))


@query("bump_retrieval", """b AS (SELECT ep_id AS id, list(t ORDER BY t) AS t FROM accesses GROUP BY 1)
    SELECT e.id, round(coalesce(b.t[-1], last_accessed), 3) AS last_accessed, retrieval_count + coalesce(len(b.t), 0) AS retrieval_count,
      CAST(len(list_concat(access_history, coalesce(b.t, []))[-32:]) AS INT) AS n, round(list_concat(access_history, coalesce(b.t, []))[-32:][1], 3) AS oldest FROM episodic e LEFT JOIN b USING (id)""")
def bump_retrieval(spark, sf):
    out = lc.bump(T.episodic(spark, sf), T.accesses(spark, sf).select(F.col("ep_id").alias("id"), "t"))
    return out.select("id", F.round("last_accessed", 3).alias("last_accessed"), F.col("retrieval_count").cast("long").alias("retrieval_count"), F.size("access_history").alias("n"), F.round(F.get("access_history", F.lit(0)), 3).alias("oldest"))


@query("cap_candidates", "SELECT id, retrieval_count FROM episodic WHERE consolidated_into = 0 ORDER BY retrieval_count DESC, id LIMIT 100")
def cap_candidates(spark, sf):
    return lc.cap_candidates(filters.unconsolidated(T.episodic(spark, sf)), 100).select("id", "retrieval_count")


_NEAREST = """pairs AS (SELECT e.id, s.id AS schema, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS d FROM episodic e, semantic s WHERE e.consolidated_into = 0),
  near AS (SELECT id, schema, d AS d1, coalesce(nxt, d) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, schema) AS r, lead(d) OVER (PARTITION BY id ORDER BY d, schema) AS nxt FROM pairs) WHERE r = 1)"""


def _candidates(spark, sf):
    return filters.unconsolidated(T.episodic(spark, sf))


@query("nearest_schema", f"{_NEAREST} SELECT id, schema, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM near")
def nearest_schema(spark, sf):
    return lc.nearest_schema(_candidates(spark, sf), T.semantic(spark, sf)).select("id", "schema", _r("d1"), _r("d2"))


_ABSORB = f"{_NEAREST}, absorbed AS (SELECT id, schema, d1, greatest(({_S}) * d1 / (1 + 2 * greatest(0, d2 - d1)), 1e-9) AS score FROM near JOIN episodic USING (id) WHERE d1 <= 0.75)"


@query("absorption", f"{_ABSORB} SELECT id, schema, round(d1, 6) AS d1, round(score, 6) AS score FROM absorbed")
def absorption(spark, sf):
    return lc.absorption(_candidates(spark, sf), T.semantic(spark, sf), NOW, NEAR).select("id", "schema", _r("d1"), _r("score"))


@query("replay_score", f"{_NEAREST} SELECT id, round(greatest(({_S}) * d1 / (1 + 2 * greatest(0, d2 - d1)), 1e-9), 6) AS score FROM near JOIN episodic USING (id)")
def replay_score(spark, sf):
    c = _candidates(spark, sf)
    near = lc.nearest_schema(c, T.semantic(spark, sf)).join(c.select("id", lc.strength(NOW).alias("s")), "id")
    return near.select("id", F.round(lc.replay_score(F.col("s"), F.col("d1"), F.col("d2")), 6).alias("score"))


@query("residual", f"{_ABSORB} SELECT id FROM episodic WHERE consolidated_into = 0 AND id NOT IN (SELECT id FROM absorbed)")
def residual(spark, sf):
    c = _candidates(spark, sf)
    return lc.residual(c, lc.absorption(c, T.semantic(spark, sf), NOW, NEAR)).select("id")


@query("merge_into_schema", f"""{_ABSORB}, n AS (SELECT schema AS id, list(id) AS new FROM absorbed GROUP BY 1), u AS (SELECT s.*, CASE WHEN n.new IS NULL THEN source_episode_ids ELSE list_sort(list_distinct(list_concat(source_episode_ids, n.new))) END AS joint FROM semantic s LEFT JOIN n USING (id))
    SELECT id, CASE WHEN len(joint) > len(source_episode_ids) THEN joint ELSE source_episode_ids END AS source_episode_ids, round(CASE WHEN len(joint) > len(source_episode_ids) THEN least(1, len(joint) / 5) ELSE confidence END, 6) AS confidence,
      CASE WHEN len(joint) > len(source_episode_ids) THEN {NOW}.0 ELSE updated_at END AS updated_at FROM u""")
def merge_into_schema(spark, sf):
    absorbed = lc.absorption(_candidates(spark, sf), T.semantic(spark, sf), NOW, NEAR)
    return lc.merge_into_schema(T.semantic(spark, sf), absorbed, NOW).select("id", "source_episode_ids", _r("confidence"), "updated_at")


@query("merge_sources", "SELECT a.id, list_sort(list_distinct(list_concat(a.source_episode_ids, b.source_episode_ids))) AS sources FROM semantic a JOIN semantic b ON b.id = a.id + 10")
def merge_sources(spark, sf):
    s = T.semantic(spark, sf).select("id", "source_episode_ids")
    other = s.select(F.col("id").alias("other"), F.col("source_episode_ids").alias("more"))
    return s.join(other, F.col("other") == F.col("id") + 10).select("id", F.array_sort(F.array_union("source_episode_ids", "more")).alias("sources"))


@query("schema_confidence", "SELECT id, round(least(1, len(source_episode_ids) / 5), 6) AS confidence FROM semantic")
def schema_confidence(spark, sf):
    return T.semantic(spark, sf).select("id", F.round(lc.confidence(F.size("source_episode_ids")), 6).alias("confidence"))


_MEMBERS = "m AS (SELECT id, content, salience, tags, session_id, id % 23 AS cluster FROM episodic)"


def _members(spark, sf):
    return T.episodic(spark, sf).withColumn("cluster", F.col("id") % 23)


@query("cluster_head", f"{_MEMBERS} SELECT cluster, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY salience DESC, id) AS r FROM m) WHERE r = 1")
def cluster_head(spark, sf):
    return lc.cluster_heads(_members(spark, sf))


@query("tag_union", f"{_MEMBERS} SELECT cluster, list_sort(list(DISTINCT t)) AS tags FROM (SELECT cluster, unnest(tags) AS t FROM m) GROUP BY cluster")
def tag_union(spark, sf):
    return lc.tag_unions(_members(spark, sf))


@query("plurality_session", f"""{_MEMBERS}, c AS (SELECT cluster, session_id, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY n DESC) AS k FROM c)
    SELECT cluster, CASE WHEN count(*) = 1 THEN min(session_id) END AS winner FROM r WHERE k = 1 GROUP BY cluster""")
def plurality_session(spark, sf):
    return lc.plurality(_members(spark, sf), "cluster", "session_id")


@query("build_gist", rf"""{_MEMBERS}, l AS (SELECT cluster, id, salience, substr(regexp_extract(regexp_replace(content, '^\s+', ''), '^[^\n\r\x0B\x0C\x1C-\x1E]*'), 1, 200) AS line FROM m),
    h AS (SELECT cluster, line AS head FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY salience DESC, id) AS r FROM l) WHERE r = 1),
    b AS (SELECT cluster, string_agg('- ' || line, chr(10) ORDER BY line) AS bullets FROM (SELECT DISTINCT l.cluster, line FROM l JOIN h USING (cluster) WHERE line <> head AND line <> '') GROUP BY cluster)
    SELECT cluster, CASE WHEN bullets IS NULL THEN head ELSE head || chr(10) || chr(10) || 'Related:' || chr(10) || bullets END AS gist FROM h LEFT JOIN b USING (cluster)""")
def build_gist(spark, sf):
    return lc.gists(_members(spark, sf))


_PARKED = "parked AS (SELECT vec_id AS id, embedding, CAST(vec_id % 4 AS INT) AS hits, CAST(vec_id % 7 AS INT) AS age, ['src' || (vec_id % 20)] AS sessions, [CAST(vec_id % 3 AS BIGINT)] AS epochs FROM embeddings WHERE vec_id % 5 = 3)"


def _parked(spark, sf):
    return T.raw(spark, sf, "embeddings").where("vec_id % 5 = 3").selectExpr("vec_id as id", "embedding", "cast(vec_id % 4 as int) as hits", "cast(vec_id % 7 as int) as age", "array(concat('src', vec_id % 20)) as sessions", "array(vec_id % 3) as epochs")


@query("age_candidates", f"{_PARKED} SELECT id, age + 1 AS age, CAST(greatest(1, floor(hits * 0.5)) AS INT) AS hits FROM parked WHERE age + 1 <= 5")
def age_candidates(spark, sf):
    return lc.age_candidates(_parked(spark, sf), Config(candidate_hit_decay=0.5)).select("id", "age", "hits")


_GIST_NEAR = f"""{_PARKED}, p AS (SELECT s.id, c.id AS candidate, list_cosine_distance(CAST(s.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d FROM semantic s, parked c),
  gn AS (SELECT id, candidate, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, candidate) AS r FROM p) WHERE r = 1 AND d <= 0.72)"""


@query("nearest_candidate", f"{_GIST_NEAR} SELECT id, candidate, round(distance, 6) AS distance FROM gn")
def nearest_candidate(spark, sf):
    return lc.nearest_candidate(T.semantic(spark, sf), _parked(spark, sf), 0.72).select("id", "candidate", _r("distance"))


@query("promotion_gate", f"""{_GIST_NEAR}, j AS (SELECT s.id, gn.candidate, c.hits, len(list_distinct(c.sessions || [s.session_id])) AS ns, len(list_distinct(c.epochs || [s.id % 4])) AS ne FROM semantic s LEFT JOIN gn USING (id) LEFT JOIN parked c ON c.id = gn.candidate)
    SELECT id, candidate, CASE WHEN candidate IS NULL THEN 'park' WHEN hits + 1 >= 2 AND ns >= 2 AND ne >= 2 THEN 'promote' ELSE 'update' END AS decision, coalesce(hits + 1, 1) AS hits FROM j""")
def promotion_gate(spark, sf):
    gists = T.semantic(spark, sf).withColumn("epoch", F.col("id") % 4)
    return lc.promotion(gists, _parked(spark, sf), Config(schema_merge_distance=0.72, min_hit_sessions=2, min_hit_epochs=2))


@query("kmeans_clusters")  # k-means starts from a random draw; tests check that it partitions
def kmeans_clusters(spark, sf):
    c = _candidates(spark, sf)
    return lc.kmeans(c, lc.n_clusters(c.count())).select("id", "cluster")


@query("stage2_decisions")  # clusters of one pass act on each other in turn; tests drive the state machine
def stage2_decisions(spark, sf):
    c = _candidates(spark, sf)
    return cs.consolidate(c, T.semantic(spark, sf), cs.empty_candidates(spark), epoch=1, now=NOW, cfg=NEAR).decisions


@query("candidate_buffer")
def candidate_buffer(spark, sf):
    """Two passes over the same candidates: what recurs is promoted."""
    c, s = _candidates(spark, sf), T.semantic(spark, sf)
    first = cs.consolidate(c, s, cs.empty_candidates(spark), 1, NOW, NEAR)
    return cs.consolidate(c, s, first.candidates, 2, NOW, NEAR).decisions


@query("dedup_cosine", """p AS (SELECT a.id, b.id AS match, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM episodic a JOIN episodic b ON a.session_id = b.session_id AND b.id < a.id WHERE length(trim(a.content)) >= 8)
    SELECT id, match, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, match) AS r FROM p) WHERE r = 1 AND d <= 0.85""")
def dedup_cosine(spark, sf):
    return cs.dedup_cosine(T.episodic(spark, sf), Config(dedup_distance=0.85)).select("id", "match", _r("distance"))


@query("dedup_jaccard")  # compares seeded sparse codes
def dedup_jaccard(spark, sf):
    return cs.dedup_jaccard(codes.with_support(T.episodic(spark, sf)), Config(code_jaccard=0.2))


@query("surprise_boost", """p AS (SELECT a.id, min(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM episodic a JOIN episodic b ON a.session_id = b.session_id AND b.id < a.id GROUP BY a.id)
    SELECT e.id, round(CASE WHEN p.d >= 0.8 THEN least(1, salience + 0.1) ELSE salience END, 6) AS salience FROM episodic e LEFT JOIN p USING (id)""")
def surprise_boost(spark, sf):
    return cs.surprise(T.episodic(spark, sf), Config(surprise_floor=0.8)).select("id", _r("salience"))


@query("supersede", "gone AS (SELECT id FROM episodic WHERE coalesce(episode_group_id, id) IN (5, 12, 25, 33)) SELECT id FROM episodic WHERE id NOT IN (SELECT id FROM gone)")
def supersede(spark, sf):
    targets = spark.createDataFrame([(6, 900), (12, 901), (25, 902), (33, 903), (43, 43)], "target long, new_group long")
    return cs.supersede(T.episodic(spark, sf), targets).select("id")


@query("group_head", "SELECT s.id, coalesce(h.id, s.id) AS head, coalesce(h.salience, s.salience) AS head_salience FROM episodic s LEFT JOIN episodic h ON h.id = s.episode_group_id")
def group_head(spark, sf):
    e = T.episodic(spark, sf)
    heads = e.select(F.col("id").alias("_h"), F.col("salience").alias("_s"))
    return e.join(heads, F.col("episode_group_id") == F.col("_h"), "left").select("id", F.coalesce("_h", "id").alias("head"), F.coalesce("_s", "salience").alias("head_salience"))


@query("reflect_recent", "SELECT id, last_accessed FROM (SELECT * FROM episodic WHERE session_id = 'src3' ORDER BY id LIMIT 50) ORDER BY last_accessed DESC, id LIMIT 5")
def reflect_recent(spark, sf):
    return lc.reflect_recent(T.episodic(spark, sf), "src3", 5).select("id", "last_accessed")


@query("reflect_schemas", """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), k AS (SELECT s.*, list_cosine_distance(CAST(s.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS d FROM semantic s, q ORDER BY d, id LIMIT 32)
    SELECT id, round(d, 6) AS distance FROM k WHERE scope = 'global' OR session_id = 'src3' ORDER BY d, id LIMIT 5""")
def reflect_schemas(spark, sf):
    q = T.raw(spark, sf, "embeddings").where("vec_id = 0").selectExpr("vec_id as query_id", "embedding as vector")
    hits = rc.knn(T.semantic(spark, sf), q, rc.fetch_k(5, True), ("scope", "session_id")).where(filters.visible(F.lit("src3")))
    return hits.orderBy("distance", "id").limit(5).select("id", _r("distance"))


@query("schema_health", f"""t AS (SELECT id, len(source_episode_ids) AS n, list_distinct(list_filter(tags, lambda t: regexp_matches(t, '^topic-[0-9]+$'))) AS topics, coalesce(last_accessed, created_at) AS seen FROM semantic)
    SELECT count(*) AS total, count(*) FILTER (WHERE n <= 1) AS singletons, count(*) FILTER (WHERE {NOW} - seen > 5000000) AS stale, median(n) AS median_sources, count(*) FILTER (WHERE len(topics) = 1) AS pure, count(*) FILTER (WHERE len(topics) > 1) AS mixed,
      count(*) FILTER (WHERE len(topics) = 0) AS untagged, (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(topics) AS x FROM t) GROUP BY x)) AS max_per_topic FROM t""")
def schema_health(spark, sf):
    return ev.schema_health(T.semantic(spark, sf), NOW, 5_000_000)


@query("tool_metrics", """n AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY seq DESC) AS r FROM tool_calls)
    SELECT tool, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors, round(quantile_disc(CASE WHEN r <= 200 THEN seconds END, 0.5) * 1000, 6) AS p50_ms, round(quantile_disc(CASE WHEN r <= 200 THEN seconds END, 0.95) * 1000, 6) AS p95_ms FROM n GROUP BY tool""")
def tool_metrics(spark, sf):
    return ev.tool_metrics(T.tool_calls(spark, sf))


@query("schema_session", """s AS (SELECT m.id AS schema, e.session_id, count(*) AS n FROM (SELECT id, unnest(source_episode_ids) AS src FROM semantic) m JOIN episodic e ON e.id = m.src GROUP BY 1, 2)
    SELECT c.id AS schema, coalesce(b.session_id, 'orphan') AS session_id FROM semantic c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY schema ORDER BY n DESC, session_id) AS r FROM s) b ON b.schema = c.id AND r = 1""")
def schema_session(spark, sf):
    sources = T.semantic(spark, sf).select(F.col("id").alias("schema"), F.explode_outer("source_episode_ids").alias("src"))
    j = sources.join(T.episodic(spark, sf).select(F.col("id").alias("src"), "session_id"), "src", "left")
    counts = j.groupBy("schema", "session_id").agg(F.count("session_id").alias("n"))
    return counts.groupBy("schema").agg(F.coalesce(F.min_by("session_id", F.struct(-F.col("n"), F.col("session_id"))), F.lit("orphan")).alias("session_id"))


@query("context_chain", "SELECT * FROM (SELECT session_id, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, id) AS prev, id FROM episodic) WHERE prev IS NOT NULL")
def context_chain(spark, sf):
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return T.episodic(spark, sf).select("session_id", F.lag("id").over(w).alias("prev"), "id").where("prev is not null")


@query("segment_chain", "SELECT * FROM (SELECT episode_group_id, lag(id) OVER (PARTITION BY episode_group_id ORDER BY position_in_episode) AS prev, id FROM episodic WHERE episode_group_id IS NOT NULL) WHERE prev IS NOT NULL")
def segment_chain(spark, sf):
    w = Window.partitionBy("episode_group_id").orderBy("position_in_episode")
    return T.episodic(spark, sf).where("episode_group_id is not null").select("episode_group_id", F.lag("id").over(w).alias("prev"), "id").where("prev is not null")
