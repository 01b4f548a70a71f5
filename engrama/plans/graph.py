"""Co-access, plasticity, spreading, neighbourhoods and the interaction log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrama.config import Config
from engrama.operators import graph as gr
from engrama.operators import lifecycle as lc
from engrama.operators import reactor as rx
from engrama.sources import tables as T

from . import lifecycle as ll
from .registry import query

NOW = T.NOW


def _r(c, d=6):
    return F.round(c, d).alias(c)


_PAIRS = "pairs AS (SELECT p.ep_id AS src, c.ep_id AS dst, c.seq FROM accesses c JOIN accesses p ON p.seq < c.seq AND p.t >= c.t - {w} AND p.t <= c.t AND p.ep_id <> c.ep_id)"
_W = 600


@query("sr_tally", f"{_PAIRS.format(w=60)} SELECT src, dst, count(*) AS hits FROM pairs GROUP BY src, dst")
def sr_tally(spark, sf):
    return gr.tally(T.accesses(spark, sf))


@query("sr_recall_tally", """sets AS (SELECT seq, ep_id AS anchor, [ep_id % 5 + 500, ep_id % 3 + 600] AS others, t FROM accesses),
    p AS (SELECT p.ep_id AS src, c.ep_id AS dst FROM accesses c JOIN accesses p ON p.seq < c.seq AND p.t >= c.t - 60 AND p.t <= c.t AND p.ep_id <> c.ep_id UNION ALL SELECT anchor, unnest(others) FROM sets)
    SELECT src, dst, count(*) AS hits FROM p WHERE src <> dst GROUP BY src, dst""")
def sr_recall_tally(spark, sf):
    sets = T.accesses(spark, sf).selectExpr("seq", "ep_id as anchor", "array(ep_id % 5 + 500, ep_id % 3 + 600) as others", "t")
    return gr.recall_tally(sets)


@query("sr_td_closure")  # each update reads what earlier ones wrote; a test folds it in plain Python
def sr_td_closure(spark, sf):
    pairs = gr.window_pairs(T.accesses(spark, sf), 60.0).selectExpr("prior as src", "cur as dst", "seq")
    return gr.td_closure(pairs, ["seq", "src"]).select("src", "dst", _r("m"))


@query("sr_rebuild")  # two sweeps of the same fold over the stored edges
def sr_rebuild(spark, sf):
    return gr.td_closure(gr.tally(T.accesses(spark, sf)), ["src", "dst"], sweeps=2).select("src", "dst", _r("m"))


@query("sr_power_series", """t AS (SELECT src_id AS src, dst_id AS dst, sum(hits)::DOUBLE / sum(sum(hits)) OVER (PARTITION BY src_id) AS p FROM edges WHERE kind = 'sr' GROUP BY 1, 2),
    t2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM t a JOIN t b ON a.dst = b.src GROUP BY 1, 2), t3 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM t2 a JOIN t b ON a.dst = b.src GROUP BY 1, 2)
    SELECT src, dst, round(sum(m), 6) AS m FROM (SELECT src, dst, p AS m FROM t UNION ALL SELECT src, dst, 0.7::DOUBLE * p FROM t2 UNION ALL SELECT src, dst, 0.7::DOUBLE * 0.7::DOUBLE * p FROM t3) GROUP BY src, dst""")
def sr_power_series(spark, sf):
    e = T.edges(spark, sf).where("kind = 'sr'").selectExpr("src_id as src", "dst_id as dst", "hits")
    return gr.power_series(e).select("src", "dst", _r("m"))


@query("sr_anchor_closure", """t AS (SELECT src_id AS src, dst_id AS dst, sum(hits)::DOUBLE / sum(sum(hits)) OVER (PARTITION BY src_id) AS p FROM edges WHERE kind = 'sr' GROUP BY 1, 2), a AS (SELECT vec_id + 1 AS id FROM embeddings WHERE vec_id % 100 = 0),
    t1 AS (SELECT * FROM t WHERE src IN (SELECT id FROM a)), t2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM t1 a JOIN t b ON a.dst = b.src GROUP BY 1, 2), t3 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM t2 a JOIN t b ON a.dst = b.src GROUP BY 1, 2)
    SELECT src, dst, round(sum(m), 6) AS m FROM (SELECT src, dst, p AS m FROM t1 UNION ALL SELECT src, dst, 0.7::DOUBLE * p FROM t2 UNION ALL SELECT src, dst, 0.7::DOUBLE * 0.7::DOUBLE * p FROM t3) GROUP BY src, dst""")
def sr_anchor_closure(spark, sf):
    e = T.edges(spark, sf).where("kind = 'sr'").selectExpr("src_id as src", "dst_id as dst", "hits")
    anchors = T.raw(spark, sf, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id + 1 as id")
    return gr.power_series(e, depth=3, anchors=anchors).select("src", "dst", _r("m"))


@query("sr_evict", f"{_PAIRS.format(w=60)} SELECT src, dst, count(*) AS hits FROM pairs WHERE src % 10 <> 3 AND dst % 10 <> 3 GROUP BY src, dst")
def sr_evict(spark, sf):
    gone = T.accesses(spark, sf).where("ep_id % 10 = 3").selectExpr("ep_id as id").distinct()
    return gr.tally_without(T.accesses(spark, sf), gone)


@query("sr_omega", "SELECT round(0.3 * least(1, (SELECT sum(hits) FROM edges WHERE kind = 'sr')::DOUBLE / greatest(1, (SELECT count(*) FROM episodic) * 20.0)), 6) AS omega")
def sr_omega(spark, sf):
    total = T.edges(spark, sf).where("kind = 'sr'").agg(F.sum("hits").alias("t")).first().t or 0
    return spark.createDataFrame([(round(gr.omega(total, T.episodic(spark, sf).count(), Config(sr_cold_start_ratio=20.0)), 6),)], "omega double")


@query("sr_boost", "c AS (SELECT src_id, dst_id, hits::DOUBLE / sum(hits) OVER (PARTITION BY src_id) AS m FROM edges WHERE kind = 'sr') SELECT c.src_id AS anchor, e.id, round(c.m, 6) AS m FROM episodic e JOIN c ON c.dst_id = e.id")
def sr_boost(spark, sf):
    e = T.edges(spark, sf).where("kind = 'sr'")
    c = e.select(F.col("src_id").alias("anchor"), F.col("dst_id").alias("id"), (F.col("hits") / F.sum("hits").over(Window.partitionBy("src_id"))).alias("m"))
    return T.episodic(spark, sf).select("id").join(c, "id").select("anchor", "id", _r("m"))


@query("plasticity_boost", "SELECT g.src_id AS anchor, e.id, round(sum(CASE WHEN kind = 'sr' THEN hits / 100.0::DOUBLE ELSE weight + bonus END), 6) AS boost FROM episodic e JOIN edges g ON g.dst_id = e.id GROUP BY 1, 2")
def plasticity_boost(spark, sf):
    g = T.edges(spark, sf).select(F.col("src_id").alias("anchor"), F.col("dst_id").alias("id"), F.when(F.col("kind") == "sr", F.col("hits") / 100).otherwise(F.col("weight") + F.col("bonus")).alias("b"))
    return T.episodic(spark, sf).select("id").join(g.groupBy("anchor", "id").agg(F.sum("b").alias("boost")), "id").select("anchor", "id", _r("boost"))


@query("plasticity_fold", """ev AS (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY t, seq) AS n FROM reinforcements WHERE src_id <> dst_id),
    f AS (SELECT src_id, dst_id, n, 0.0::DOUBLE AS weight, 0.5::DOUBLE * greatest(0, least(1, score)) AS bonus, 1 AS hits, 1 AS win, t FROM ev WHERE n = 1
      UNION ALL SELECT src_id, dst_id, n, CASE WHEN w >= 3 THEN weight + b ELSE weight END, CASE WHEN w >= 3 THEN 0 ELSE b END, hits + 1, CASE WHEN w >= 3 THEN 0 ELSE w END, t FROM (
        SELECT f.src_id, f.dst_id, e.n, f.weight, f.hits, e.t, f.bonus * exp(-greatest(0, e.t - f.t) / 7200) + 0.5::DOUBLE * greatest(0, least(1, e.score)) * CASE WHEN f.hits >= 250 THEN 3 ELSE 1 END AS b,
          CASE WHEN e.t - f.t <= 7200 THEN f.win + 1 ELSE 1 END AS w FROM f JOIN ev e ON e.src_id = f.src_id AND e.dst_id = f.dst_id AND e.n = f.n + 1))
    SELECT src_id, dst_id, round(weight, 6) AS weight, round(bonus, 6) AS bonus, hits, win AS hits_in_window FROM (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY n DESC) AS last FROM f) WHERE last = 1""")
def plasticity_fold(spark, sf):
    return gr.plasticity_fold(T.reinforcements(spark, sf)).select("src_id", "dst_id", _r("weight"), _r("bonus"), "hits", "hits_in_window")


_LTD = f"""l AS (SELECT src_id, dst_id, hits, weight * pow(CASE WHEN hits >= 250 THEN 1 - 0.02 * 0.18 ELSE 1 - 0.02 END::DOUBLE, greatest(0, {NOW} - last_touch) * 24 / 86400) AS weight, bonus * exp(-greatest(0, {NOW} - last_touch) / 7200) AS bonus FROM edges WHERE kind = 'plasticity')"""


@query("ltd_pass", f"{_LTD} SELECT src_id, dst_id, round(weight, 6) AS weight, round(bonus, 6) AS bonus, weight + bonus < 0.001 AND hits < 250 AS pruned FROM l")
def ltd_pass(spark, sf):
    return gr.ltd(T.edges(spark, sf), NOW).select("src_id", "dst_id", _r("weight"), _r("bonus"), "pruned")


@query("dream_pass", f"""{_LTD}, {ll.TOP_SQL}, g AS (SELECT *, row_number() OVER w AS r, first_value(id) OVER w AS anchor, avg(salience) OVER (PARTITION BY session_id) AS mean FROM top WINDOW w AS (PARTITION BY session_id ORDER BY strength DESC, id))
    SELECT src_id, dst_id, round(weight, 6) AS weight, 'kept' AS what FROM l WHERE NOT (weight + bonus < 0.001 AND hits < 250) UNION ALL SELECT anchor, id, round(least(1, 0.3 * mean), 6), 'replayed' FROM g WHERE r > 1""")
def dream_pass(spark, sf):
    kept = gr.ltd(T.edges(spark, sf), NOW).where("not pruned").selectExpr("src_id", "dst_id", "round(weight, 6) as weight", "'kept' as what")
    replayed = lc.replay_edges(T.episodic(spark, sf), NOW, Config(replay_top_k=64)).selectExpr("anchor as src_id", "target as dst_id", "round(score, 6) as weight", "'replayed' as what")
    return kept.union(replayed)


@query("plasticity_stats", "SELECT count(*) AS edges, count(*) FILTER (WHERE hits >= 250) AS habits, max(hits) AS max_hits, max(weight) AS max_weight FROM edges WHERE kind = 'plasticity'")
def plasticity_stats(spark, sf):
    return gr.strength(T.edges(spark, sf)).agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("is_habit"), 1)).alias("habits"), F.max("hits").alias("max_hits"), F.max("weight").alias("max_weight"))


@query("edge_state", "SELECT src_id, dst_id, weight, bonus, round(weight + bonus, 6) AS edge_weight, hits, hits >= 250 AS is_habit FROM edges WHERE kind = 'plasticity'")
def edge_state(spark, sf):
    return gr.strength(T.edges(spark, sf)).select("src_id", "dst_id", "weight", "bonus", _r("edge_weight"), "hits", "is_habit")


@query("spreading", """fan AS (SELECT src_id, dst_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY weight DESC, dst_id) AS r FROM edges WHERE kind = 'plasticity' AND weight > 0) WHERE r <= 8),
    a AS (SELECT vec_id + 2 AS anchor FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT anchor, anchor AS id, 1.0::DOUBLE AS v, 0 AS h FROM a UNION ALL SELECT s.anchor, f.dst_id, s.v * 0.5::DOUBLE * f.weight, s.h + 1 FROM s JOIN fan f ON f.src_id = s.id WHERE s.h < 2)
    SELECT anchor, id, round(max(v), 6) AS activation FROM s GROUP BY anchor, id""")
def spreading(spark, sf):
    anchors = T.raw(spark, sf, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id + 2 as anchor")
    return gr.spreading(T.edges(spark, sf), anchors, hops=2).select("anchor", "id", _r("activation"))


_ADJ = "adj AS (SELECT src_id AS id, dst_id AS nb FROM edges UNION SELECT dst_id, src_id FROM edges)"


@query("adjacent", f"{_ADJ} SELECT id, nb AS neighbour FROM adj")
def adjacent(spark, sf):
    return gr.adjacency(T.edges(spark, sf))


@query("focus_neighborhood", f"""{_ADJ}, l1 AS (SELECT nb AS id FROM (SELECT nb, min(id) AS parent FROM adj WHERE id IN (8, 15) AND nb NOT IN (8, 15) GROUP BY nb ORDER BY parent, nb LIMIT 38)),
    s1 AS (SELECT 8 AS id, 0 AS depth UNION ALL SELECT 15, 0 UNION ALL SELECT id, 1 FROM l1),
    l2 AS (SELECT nb AS id FROM (SELECT nb, min(adj.id) AS parent FROM adj JOIN l1 ON adj.id = l1.id WHERE nb NOT IN (SELECT id FROM s1) GROUP BY nb ORDER BY parent, nb) LIMIT greatest(0, 40 - (SELECT count(*) FROM s1)))
    SELECT id, depth FROM s1 UNION ALL SELECT id, 2 FROM l2""")
def focus_neighborhood(spark, sf):
    return gr.focus(T.edges(spark, sf), spark.createDataFrame([(8,), (15,)], "id long"), 2, 40)


@query("plasticity_overlay", "n AS (SELECT id FROM episodic WHERE salience > 0.5) SELECT src_id, dst_id, weight FROM edges WHERE kind = 'plasticity' AND src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)")
def plasticity_overlay(spark, sf):
    return gr.overlay(T.edges(spark, sf), T.episodic(spark, sf).where("salience > 0.5").select("id")).select("src_id", "dst_id", "weight")


@query("global_sr", """e AS (SELECT * FROM edges WHERE kind = 'sr'), n AS (SELECT DISTINCT id FROM (SELECT src_id AS id FROM e UNION ALL SELECT dst_id FROM e) ORDER BY id LIMIT 200)
    SELECT src_id, dst_id, hits FROM e WHERE src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)""")
def global_sr(spark, sf):
    return gr.global_view(T.edges(spark, sf), 200).select("src_id", "dst_id", "hits")


@query("graph_sr_edges", "c AS (SELECT src_id, dst_id, sum(hits)::DOUBLE / sum(sum(hits)) OVER (PARTITION BY src_id) AS m FROM edges WHERE kind = 'sr' GROUP BY 1, 2) SELECT e.src_id, e.dst_id, e.hits, round(coalesce(c.m, 0), 6) AS m FROM edges e LEFT JOIN c USING (src_id, dst_id) WHERE e.kind = 'sr'")
def graph_sr_edges(spark, sf):
    e = T.edges(spark, sf).where("kind = 'sr'")
    c = gr.power_series(e.selectExpr("src_id as src", "dst_id as dst", "hits"), depth=1).selectExpr("src as src_id", "dst as dst_id", "m")
    return e.join(c, ["src_id", "dst_id"], "left").select("src_id", "dst_id", "hits", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("m"))


_CROSS = """x AS (SELECT e.src_id, e.dst_id, weight + bonus AS w FROM edges e JOIN episodic a ON a.id = e.src_id JOIN episodic b ON b.id = e.dst_id WHERE kind = 'plasticity' AND a.session_id <> b.session_id),
  scores AS (SELECT id, sum(w) AS score FROM (SELECT src_id AS id, w FROM x UNION ALL SELECT dst_id, w FROM x) GROUP BY id)"""


def _scores(spark, sf):
    return gr.bridge_scores(gr.strength(T.edges(spark, sf)), T.episodic(spark, sf).selectExpr("id", "session_id as community"))


@query("bridge_scores", f"{_CROSS} SELECT id, round(score, 6) AS score FROM scores")
def bridge_scores(spark, sf):
    return _scores(spark, sf).select("id", _r("score"))


@query("bridge_nodes", f"{_CROSS}, z AS (SELECT id, round(score, 6) AS score FROM scores WHERE round(score, 6) > 0), cut AS (SELECT score AS c FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i FROM z) WHERE i = (SELECT CAST(floor(0.75 * count(*)) AS BIGINT) FROM z)) SELECT id, score FROM z, cut WHERE score >= c")
def bridge_nodes(spark, sf):
    return gr.bridges(_scores(spark, sf).select("id", _r("score")))


_DRIFT = """ev AS (SELECT ep_id, t, seq, 0.2 + (seq % 9) / 10 AS score, row_number() OVER (PARTITION BY ep_id ORDER BY t, seq) AS n FROM accesses)"""


@query("drift_fold", f"""{_DRIFT}, f AS (SELECT ep_id, 0::BIGINT AS n, 0.0::DOUBLE AS total, false AS locked, 0.0::DOUBLE AS last FROM (SELECT DISTINCT ep_id FROM ev)
      UNION ALL SELECT ep_id, n, CASE WHEN skip OR late THEN total ELSE total + 0.05::DOUBLE * score END, locked OR (NOT skip AND NOT late AND total + 0.05::DOUBLE * score >= 0.3), CASE WHEN skip THEN last ELSE t END FROM (
        SELECT f.ep_id, e.n, f.total, f.locked, f.last, e.t, e.score, f.locked OR e.score < 0.4 AS skip, f.last > 0 AND e.t - f.last > 600000 AS late FROM f JOIN ev e ON e.ep_id = f.ep_id AND e.n = f.n + 1))
    SELECT ep_id, round(total, 6) AS drift_total, locked AS drift_locked, round(last, 3) AS last FROM (SELECT *, row_number() OVER (PARTITION BY ep_id ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def drift_fold(spark, sf):
    touches = T.accesses(spark, sf).select("ep_id", "t", "seq", (F.lit(0.2) + (F.col("seq") % 9) / 10).alias("score"))
    return gr.drift_fold(touches, Config(drift_max=0.3, drift_window_seconds=600_000.0)).select("ep_id", _r("drift_total"), "drift_locked", F.round("last", 3).alias("last"))


# the interaction log

_LOG = "lg AS (SELECT seq, ts, CASE WHEN seq % 400 = 0 THEN 'consolidate' WHEN seq % 333 = 0 THEN 'dream' ELSE kind END AS kind, session_id, deduped FROM interaction_log)"


def _log(spark, sf):
    return T.interaction_log(spark, sf).withColumn("kind", F.expr("case when seq % 400 = 0 then 'consolidate' when seq % 333 = 0 then 'dream' else kind end"))


_STATE = f"""{_LOG}, g AS (SELECT *, count(*) FILTER (WHERE kind = 'consolidate') OVER w AS c, count(*) FILTER (WHERE kind = 'dream') OVER w AS d, lag(ts) OVER (ORDER BY seq) AS prev_ts,
    max(CASE WHEN kind = 'consolidate' THEN ts END) OVER w AS last_consolidate, max(CASE WHEN kind = 'dream' THEN ts END) OVER w AS last_dream FROM lg WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  st AS (SELECT *, sum(CASE WHEN kind = 'encode' AND NOT coalesce(deduped, false) THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY seq ROWS UNBOUNDED PRECEDING) AS novel, sum(CASE WHEN kind = 'dream' THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY seq ROWS UNBOUNDED PRECEDING) AS since_dream FROM g)"""


@query("reactor_state", f"{_STATE} SELECT seq, CAST(novel AS BIGINT) AS novel, CAST(since_dream AS BIGINT) AS since_dream, round(prev_ts, 3) AS prev_ts, round(last_consolidate, 3) AS last_consolidate, round(last_dream, 3) AS last_dream FROM st")
def reactor_state(spark, sf):
    return rx.state(_log(spark, sf)).select("seq", "novel", "since_dream", _r("prev_ts", 3), _r("last_consolidate", 3), _r("last_dream", 3))


@query("reactor_triggers", f"{_STATE} SELECT seq, novel >= 32 AND ts - coalesce(last_consolidate, 0) >= 600 AS consolidate_due, since_dream > 0 AND (since_dream >= 128 OR coalesce(ts - prev_ts >= 600 AND prev_ts > 0, false)) AS dream_due FROM st")
def reactor_triggers(spark, sf):
    return rx.triggers(rx.state(_log(spark, sf))).select("seq", "consolidate_due", "dream_due")


@query("reactor_simulation", """o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM interaction_log),
    f AS (SELECT session_id, 0::BIGINT AS n, 0::BIGINT AS seq, 0 AS novel, 0 AS since, 0.0::DOUBLE AS last, 0.0::DOUBLE AS lc, false AS c, false AS d FROM (SELECT DISTINCT session_id FROM o)
      UNION ALL SELECT session_id, n, seq, CASE WHEN c THEN 0 ELSE nv END, CASE WHEN d THEN 0 ELSE sd END, ts, CASE WHEN c THEN ts ELSE lc END, c, d FROM (
        SELECT *, nv >= 32 AND ts - lc >= 600 AS c, sd >= 128 OR (last > 0 AND ts - last >= 600) AS d FROM (
          SELECT o.session_id, o.n, o.seq, o.ts, f.lc, f.last, f.novel + CASE WHEN o.kind = 'encode' AND NOT coalesce(o.deduped, false) THEN 1 ELSE 0 END AS nv, f.since + 1 AS sd FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)))
    SELECT session_id AS store, seq, 'consolidate' AS trigger FROM f WHERE c UNION ALL SELECT session_id, seq, 'dream' FROM f WHERE d""")
def reactor_simulation(spark, sf):
    return rx.simulate(T.interaction_log(spark, sf), store="session_id").select("store", "seq", "trigger")


@query("idle_sessions", """b AS (SELECT session_id, ts, sum(s) OVER (PARTITION BY session_id ORDER BY ts, seq) AS burst FROM (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) >= 600, true) THEN 1 ELSE 0 END AS s FROM interaction_log))
    SELECT session_id, round(min(ts), 3) AS started, round(max(ts), 3) AS ended, count(*) AS events FROM b GROUP BY session_id, burst""")
def idle_sessions(spark, sf):
    return rx.idle_sessions(T.interaction_log(spark, sf), 600.0).select("session_id", _r("started", 3), _r("ended", 3), "events")
