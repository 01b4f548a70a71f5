"""Read models: counts, graph payloads, details and searches over both stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrama.functions import text as tx
from engrama.operators import clusters as cl
from engrama.operators import graph as gr
from engrama.operators import reactor as rx
from engrama.operators import recall as rc
from engrama.sources import tables as T

from .registry import query


def _r(c, d=6):
    return F.round(c, d).alias(c)


@query("memory_stats", """SELECT (SELECT count(*) FROM episodic) AS episodes, (SELECT count(*) FROM semantic) AS schemas, (SELECT count(*) FROM semantic WHERE authored) AS authored,
    CAST((SELECT sum(hits) FROM edges WHERE kind = 'sr') AS BIGINT) AS sr_edges, (SELECT count(*) FROM edges WHERE kind = 'plasticity' AND hits >= 250) AS habits,
    (SELECT count(*) FROM interaction_log) AS events, (SELECT count(*) FROM interaction_log WHERE kind = 'encode' AND NOT deduped) AS novel, (SELECT round(max(ts), 3) FROM interaction_log) AS last_event""")
def memory_stats(spark, sf):
    edges = T.edges(spark, sf).agg(F.sum(F.when(F.col("kind") == "sr", F.col("hits"))).alias("sr_edges"), F.count(F.when((F.col("kind") == "plasticity") & (F.col("hits") >= 250), 1)).alias("habits"))
    state = rx.state(T.interaction_log(spark, sf)).agg(F.count(F.lit(1)).alias("events"), F.max("novel").alias("novel"), F.round(F.max("ts"), 3).alias("last_event"))
    semantic = T.semantic(spark, sf).agg(F.count(F.lit(1)).alias("schemas"), F.count(F.when(F.col("authored"), 1)).alias("authored"))
    return T.episodic(spark, sf).agg(F.count(F.lit(1)).alias("episodes")).join(semantic).join(edges).join(state)  # one row each


@query("store_composition", "SELECT (SELECT count(*) FROM episodic) AS episodes, (SELECT count(*) FROM semantic) AS schemas, round((SELECT count(*) FROM episodic)::DOUBLE / (SELECT count(*) FROM semantic), 6) AS pressure")
def store_composition(spark, sf):
    both = T.episodic(spark, sf).agg(F.count(F.lit(1)).alias("episodes")).join(T.semantic(spark, sf).agg(F.count(F.lit(1)).alias("schemas")))
    return both.withColumn("pressure", F.when(F.col("schemas") > 0, F.round(F.col("episodes") / F.col("schemas"), 6)))


@query("sim_snapshot", """e AS (SELECT count(*) AS n, count(*) FILTER (WHERE consolidated_into <> 0) AS c, avg(salience) AS s FROM episodic), g AS (SELECT count(*) FILTER (WHERE kind = 'sr') AS sr, count(*) FILTER (WHERE kind = 'plasticity') AS pl, max(hits) AS mh, round(max(weight), 6) AS mw FROM edges)
    SELECT n AS episodes, c AS consolidated, (SELECT count(*) FROM semantic) AS schemas, round(n::DOUBLE / greatest(1, (SELECT count(*) FROM semantic)), 6) AS episodes_per_schema, sr AS sr_edges, round(sr::DOUBLE / greatest(1, (SELECT count(DISTINCT src_id) FROM edges WHERE kind = 'sr')), 6) AS sr_edges_per_row,
      pl AS plasticity_edges, mh AS max_hits, mw AS max_weight, round(s, 6) AS mean_salience FROM e, g""")
def sim_snapshot(spark, sf):
    e = T.episodic(spark, sf).agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(F.col("consolidated_into") != 0, 1)).alias("consolidated"), F.round(F.avg("salience"), 6).alias("mean_salience"))
    sr, pl = F.col("kind") == "sr", F.col("kind") == "plasticity"
    g = T.edges(spark, sf).agg(F.count(F.when(sr, 1)).alias("sr_edges"), F.count_distinct(F.when(sr, F.col("src_id"))).alias("_rows"), F.count(F.when(pl, 1)).alias("plasticity_edges"), F.max("hits").alias("max_hits"), F.round(F.max("weight"), 6).alias("max_weight"))
    out = e.join(T.semantic(spark, sf).agg(F.count(F.lit(1)).alias("schemas"))).join(g)
    per = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)
    return out.withColumns({"episodes_per_schema": per("episodes", "schemas"), "sr_edges_per_row": per("sr_edges", "_rows")}).drop("_rows")


_FLAT = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"


@query("graph_nodes", f"""SELECT 'epi:' || id AS key, 'episodic' AS kind, 'memory #' || id AS label, CASE WHEN length({_FLAT}) <= 140 THEN {_FLAT} ELSE substr({_FLAT}, 1, 140) || '…' END AS preview, salience AS weight FROM episodic
    UNION ALL SELECT 'sem:' || id, 'semantic', CASE WHEN authored THEN 'memory #' ELSE 'schema #' END || id, CASE WHEN length({_FLAT}) <= 140 THEN {_FLAT} ELSE substr({_FLAT}, 1, 140) || '…' END, confidence FROM semantic""")
def graph_nodes(spark, sf):
    p = tx.preview(F.col("content")).alias("preview")
    e = T.episodic(spark, sf).select(F.concat(F.lit("epi:"), "id").alias("key"), F.lit("episodic").alias("kind"), F.concat(F.lit("memory #"), "id").alias("label"), p, F.col("salience").alias("weight"))
    s = T.semantic(spark, sf).select(F.concat(F.lit("sem:"), "id").alias("key"), F.lit("semantic").alias("kind"), F.concat(F.when(F.col("authored"), "memory #").otherwise("schema #"), "id").alias("label"), p, F.col("confidence").alias("weight"))
    return e.unionByName(s)


@query("consolidation_edges", "SELECT 'epi:' || e.id AS src, 'sem:' || s.id AS dst FROM episodic e JOIN semantic s ON s.id = e.consolidated_into")
def consolidation_edges(spark, sf):
    s = T.semantic(spark, sf).select(F.col("id").alias("consolidated_into"))
    return T.episodic(spark, sf).join(s, "consolidated_into").select(F.concat(F.lit("epi:"), "id").alias("src"), F.concat(F.lit("sem:"), "consolidated_into").alias("dst"))


@query("orphan_schemas", "SELECT id FROM semantic WHERE id NOT IN (SELECT consolidated_into FROM episodic)")
def orphan_schemas(spark, sf):
    return T.semantic(spark, sf).select("id").join(T.episodic(spark, sf).select(F.col("consolidated_into").alias("id")), "id", "left_anti")


@query("session_communities", "f AS (SELECT session_id, min(id) AS first FROM episodic GROUP BY 1), n AS (SELECT session_id, row_number() OVER (ORDER BY first) - 1 AS community FROM f) SELECT id, community FROM episodic JOIN n USING (session_id)")
def session_communities(spark, sf):
    e = T.episodic(spark, sf).select("id", "session_id")
    numbered = e.groupBy("session_id").agg(F.min("id").alias("first")).select("session_id", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("community"))  # a row a session
    return e.join(numbered, "session_id").select("id", "community")


@query("recent_feed", "SELECT id, created_at FROM episodic ORDER BY id DESC LIMIT 25")
def recent_feed(spark, sf):
    return T.episodic(spark, sf).select("id", "created_at").orderBy(F.col("id").desc()).limit(25)


def _substring(df, needle, k):
    at = F.instr(F.lower("content"), needle) - 1
    return df.withColumn("pos", at).where("pos >= 0").orderBy("pos", "id").limit(k).select("id", F.col("pos").cast("long").alias("pos"))


@query("substring_search", "SELECT id, strpos(lower(content), 'the') - 1 AS pos FROM episodic WHERE contains(lower(content), 'the') ORDER BY pos, id LIMIT 20")
def substring_search(spark, sf):
    return _substring(T.episodic(spark, sf), "the", 20)


_SEARCH = """one AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), k AS (SELECT id, d AS distance FROM (SELECT e.id, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(one.v AS DOUBLE[])) AS d FROM episodic e, one) ORDER BY d, id LIMIT 20),
  s AS (SELECT id, strpos(lower(content), 'the') - 1 AS pos FROM episodic WHERE contains(lower(content), 'the') ORDER BY pos, id LIMIT 20)"""


def _search(spark, sf):
    q = T.raw(spark, sf, "embeddings").where("vec_id = 0").selectExpr("vec_id as query_id", "embedding as vector")
    return rc.knn(T.episodic(spark, sf), q, 20).select("id", "distance"), _substring(T.episodic(spark, sf), "the", 20)


@query("hybrid_search", f"{_SEARCH} SELECT coalesce(k.id, s.id) AS id, round(distance, 6) AS distance, pos AS substring_offset, CASE WHEN k.id IS NULL THEN 'substring' ELSE 'semantic' END AS matched FROM k FULL JOIN s ON k.id = s.id")
def hybrid_search(spark, sf):
    k, s = _search(spark, sf)
    return k.join(s, "id", "full").select("id", _r("distance"), F.col("pos").alias("substring_offset"), F.when(F.col("distance").isNull(), "substring").otherwise("semantic").alias("matched"))


@query("search_mode", f"{_SEARCH} SELECT CASE WHEN (SELECT count(*) FROM k) > 0 AND (SELECT count(*) FROM s) > 0 THEN 'hybrid' WHEN (SELECT count(*) FROM k) > 0 THEN 'semantic' WHEN (SELECT count(*) FROM s) > 0 THEN 'substring' ELSE 'empty' END AS mode")
def search_mode(spark, sf):
    k, s = _search(spark, sf)
    counts = k.agg(F.count(F.lit(1)).alias("k")).join(s.agg(F.count(F.lit(1)).alias("s")))
    mode = F.when((F.col("k") > 0) & (F.col("s") > 0), "hybrid").when(F.col("k") > 0, "semantic").when(F.col("s") > 0, "substring").otherwise("empty")
    return counts.select(mode.alias("mode"))


@query("memory_detail", """SELECT e.id, e.episode_group_id, (SELECT count(*) FROM episodic g WHERE g.episode_group_id = e.episode_group_id) AS n_segments, (SELECT count(*) FROM edges x WHERE kind = 'sr' AND src_id = e.id) AS sr_out,
    (SELECT count(*) FROM edges x WHERE kind = 'sr' AND dst_id = e.id) AS sr_in, (SELECT count(*) FROM edges x WHERE kind = 'plasticity' AND src_id = e.id) AS plasticity_out FROM episodic e""")
def memory_detail(spark, sf):
    e = T.episodic(spark, sf).select("id", "episode_group_id")
    groups = e.where("episode_group_id is not null").groupBy("episode_group_id").agg(F.count(F.lit(1)).alias("n_segments"))
    g = T.edges(spark, sf)
    ends = g.select(F.col("src_id").alias("id"), F.when(F.col("kind") == "sr", "sr_out").otherwise("plasticity_out").alias("what")).union(g.where("kind = 'sr'").select("dst_id", F.lit("sr_in")))
    counts = ends.groupBy("id").agg(*[F.count(F.when(F.col("what") == w, 1)).alias(w) for w in ("sr_out", "sr_in", "plasticity_out")])
    out = e.join(groups, "episode_group_id", "left").join(counts, "id", "left")
    return out.select("id", "episode_group_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_segments", "sr_out", "sr_in", "plasticity_out")])


@query("lit_neighbourhood", """SELECT DISTINCT key FROM (SELECT 'epi:' || dst_id AS key FROM edges WHERE src_id = 8 UNION ALL SELECT 'epi:' || src_id FROM edges WHERE dst_id = 8 UNION ALL SELECT 'sem:' || consolidated_into FROM episodic WHERE id = 8 AND consolidated_into <> 0)""")
def lit_neighbourhood(spark, sf):
    near = gr.adjacency(T.edges(spark, sf)).where("id = 8").select(F.concat(F.lit("epi:"), "neighbour").alias("key"))
    into = T.episodic(spark, sf).where("id = 8 and consolidated_into <> 0").select(F.concat(F.lit("sem:"), "consolidated_into").alias("key"))
    return near.union(into).distinct()


@query("normalize_graph", "SELECT src_id, dst_id, coalesce(w, 0) AS weight, coalesce(b, 0) AS bonus, round(coalesce(w, 0) + coalesce(b, 0), 6) AS strength FROM (SELECT src_id, dst_id, CASE WHEN src_id % 5 > 0 THEN weight END AS w, CASE WHEN dst_id % 4 > 0 THEN bonus END AS b FROM edges WHERE kind = 'plasticity' AND dst_id % 9 > 0)")
def normalize_graph(spark, sf):
    raw = T.edges(spark, sf).where("kind = 'plasticity'").withColumns({
        "weight": F.expr("case when src_id % 5 > 0 then weight when src_id % 2 = 0 then double('nan') end"), "bonus": F.expr("case when dst_id % 4 > 0 then bonus when dst_id % 3 = 0 then double('inf') end"),
        "dst_id": F.expr("case when dst_id % 9 > 0 then dst_id end"),
    })
    usable = lambda c: F.when(rc.finite(c), F.col(c)).otherwise(0.0)
    out = raw.where("dst_id is not null").withColumns({"weight": usable("weight"), "bonus": usable("bonus")})
    return out.select("src_id", "dst_id", "weight", "bonus", F.round(F.col("weight") + F.col("bonus"), 6).alias("strength"))


@query("hull_communities", "SELECT session_id AS community, count(*) AS n, round(avg(salience), 6) AS centre FROM episodic GROUP BY 1 HAVING count(*) >= 3")
def hull_communities(spark, sf):
    nodes = T.episodic(spark, sf).select(F.col("session_id").alias("community"), F.col("salience").alias("x"))
    return gr.hull_communities(nodes).select("community", "n", F.round("centre", 6).alias("centre"))


@query("community_hulls")  # a geometric fold; a test holds it against every edge through two points
def community_hulls(spark, sf):
    nodes = T.raw(spark, sf, "embeddings").selectExpr("concat('topic-', label) as community", "embedding[0] as x", "embedding[1] as y", "abs(embedding[2]) / 10 as r")
    return cl.community_hulls(nodes).select("community", "nth", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
