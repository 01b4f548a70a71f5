"""Search, ranking, gates and evaluation over the stated query set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrama.config import Config
from engrama.operators import codes, filters
from engrama.operators import graph as gr
from engrama.operators import recall as rc
from engrama.operators import vector_index as vi
from engrama.operators.shared import cut
from engrama.sources import tables as T

from .registry import query

#: The fixtures' vectors are nearly orthogonal, so the gate's settings are looser than the defaults.
CFG = Config(ceiling_alpha=0.95, ceiling_standout=0.05, elbow_sensitivity=0.08, elbow_min_spread=0.02, gap=0.08)
K = 4

_DIST = "list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))"


def _knn_sql(name: str, table: str, k: int, extra: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS nth FROM (
      SELECT q.query_id, e.id, {_DIST} AS distance{extra} FROM {table} e, queries q)) WHERE nth <= {k})"""


_HYBRID = f"""{_knn_sql("ks", "semantic", 32, ", e.scope, e.session_id, e.tags, CAST(NULL AS BIGINT) AS episode_group_id")},
  {_knn_sql("ke", "episodic", 32, ", e.scope, e.session_id, e.tags, e.episode_group_id")},
  hits AS (SELECT *, 'semantic' AS source, 0 AS leg_order FROM ks UNION ALL SELECT *, 'episodic', 1 FROM ke),
  scoped AS (SELECT h.*, q.session_id AS caller FROM hits h JOIN queries q USING (query_id)
    WHERE CASE WHEN h.scope = 'global' THEN true WHEN h.scope = 'session' THEN h.session_id = q.session_id ELSE h.session_id IS NULL OR h.session_id = q.session_id END)"""
_CLOSURE = "closure AS (SELECT src_id AS src, dst_id AS dst, CAST(hits AS DOUBLE) / sum(hits) OVER (PARTITION BY src_id) AS m FROM edges WHERE kind = 'sr')"
_SPREAD = """anchor AS (SELECT query_id, arg_min(id, distance) AS anchor FROM scoped WHERE source = 'episodic' GROUP BY query_id),
  hop AS (SELECT anchor, dst_id AS id, 0.5::DOUBLE * weight AS a FROM (SELECT a.anchor, p.*, row_number() OVER (PARTITION BY a.anchor ORDER BY weight DESC, dst_id) AS r
    FROM (SELECT DISTINCT anchor FROM anchor) a JOIN edges p ON p.kind = 'plasticity' AND p.weight > 0 AND p.src_id = a.anchor) WHERE r <= 8),
  spread AS (SELECT anchor, id, max(a) AS activation FROM (SELECT * FROM hop UNION ALL SELECT DISTINCT anchor, anchor, 1.0::DOUBLE FROM anchor) GROUP BY anchor, id),
  omega AS (SELECT 0.3::DOUBLE * least(1.0::DOUBLE, CAST((SELECT sum(hits) FROM edges WHERE kind = 'sr') AS DOUBLE) / greatest(1, (SELECT count(*) FROM episodic))) AS w),
  ranked AS (SELECT s.*, a.anchor, CASE WHEN source = 'semantic' THEN distance ELSE (1 - w) * distance - w * coalesce(m, 0) - 0.2::DOUBLE * coalesce(activation, 0) - CASE WHEN s.session_id = caller THEN 0.05 ELSE 0.0 END END AS rank_key
    FROM scoped s LEFT JOIN anchor a USING (query_id) LEFT JOIN closure c ON c.src = a.anchor AND c.dst = s.id LEFT JOIN spread p ON p.anchor = a.anchor AND p.id = s.id, omega)"""
_COLLAPSE = """collapsed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, CASE WHEN source = 'episodic' THEN coalesce(episode_group_id, id) ELSE -id END ORDER BY rank_key, leg_order, nth) AS best FROM ranked) WHERE best = 1)"""
_REFS = f"refs AS (SELECT query_id, 'episodic' AS source, avg({_DIST}) AS reference FROM episodic e, queries q GROUP BY 1 UNION ALL SELECT query_id, 'semantic', avg({_DIST}) FROM semantic e, queries q GROUP BY 1)"


def _gate_sql(source: str, group: str, out: str) -> str:
    """Ceiling and elbow by group, then the pooled gap, over `source`, which has distance and reference."""
    return f"""
  {out}_c AS (SELECT {group}, CASE WHEN any_value(reference) > 0 AND count(*) >= {CFG.ceiling_min_points} THEN CASE WHEN max(CASE WHEN i = 2 THEN distance END) - min(distance) >= {CFG.ceiling_standout}
      THEN greatest({CFG.ceiling_alpha}::DOUBLE * any_value(reference), min(distance)) ELSE {CFG.ceiling_alpha}::DOUBLE * any_value(reference) END END AS cut
    FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY distance) AS i FROM {source}) GROUP BY {group}),
  {out}_1 AS (SELECT s.* FROM {source} s LEFT JOIN {out}_c USING ({group}) WHERE cut IS NULL OR distance <= cut + 1e-9),
  {out}_w AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY distance) - 1 AS i, lag(distance) OVER (PARTITION BY {group} ORDER BY distance) AS before,
      count(*) OVER (PARTITION BY {group}) AS n, min(distance) OVER (PARTITION BY {group}) AS lo, max(distance) OVER (PARTITION BY {group}) AS hi FROM {out}_1),
  {out}_d AS (SELECT *, (distance - lo) / (hi - lo) - CAST(i AS DOUBLE) / (n - 1) AS delta FROM {out}_w WHERE n >= {CFG.elbow_min_points} AND hi - lo >= {CFG.elbow_min_spread}),
  {out}_e AS (SELECT {group}, CASE WHEN delta >= {CFG.elbow_sensitivity} AND i >= 1 THEN before END AS cut FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY delta DESC, i) AS r FROM {out}_d) WHERE r = 1),
  {out}_2 AS (SELECT s.* FROM {out}_1 s LEFT JOIN {out}_e USING ({group}) WHERE cut IS NULL OR distance <= cut + 1e-9),
  {out}_g AS (SELECT query_id, min(CASE WHEN nxt - distance >= {CFG.gap} THEN distance END) AS cut FROM (SELECT *, lead(distance) OVER (PARTITION BY query_id ORDER BY distance) AS nxt FROM {out}_2) GROUP BY query_id),
  {out} AS (SELECT s.* FROM {out}_2 s LEFT JOIN {out}_g USING (query_id) WHERE cut IS NULL OR distance <= cut + 1e-9)"""


_RECALL = f"{_HYBRID}, {_CLOSURE}, {_SPREAD}, {_COLLAPSE}, {_REFS}, joined AS (SELECT c.*, r.reference FROM collapsed c LEFT JOIN refs r USING (query_id, source)), {_gate_sql('joined', 'query_id, source', 'gated')}"
_TOP = f"topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_key, leg_order, nth) AS position FROM gated) WHERE position <= {K})"


def _hits(spark, sf):
    q = T.queries(spark, sf)
    return q, rc.hybrid(T.episodic(spark, sf), T.semantic(spark, sf), q, rc.fetch_k(K, True))


def _scoped(spark, sf):
    q, hits = _hits(spark, sf)
    return q, hits.join(q.select("query_id", F.col("session_id").alias("caller")), "query_id").where(filters.visible(F.col("caller")))


def _closure(spark, sf):
    e = T.edges(spark, sf).where("kind = 'sr'")
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), (F.col("hits") / F.sum("hits").over(Window.partitionBy("src_id"))).alias("m"))


def _omega(spark, sf):
    total = T.edges(spark, sf).where("kind = 'sr'").agg(F.sum("hits").alias("t")).first().t or 0
    return gr.omega(total, T.episodic(spark, sf).count())


def _ranked(spark, sf):
    q, scoped = _scoped(spark, sf)
    spread = gr.spreading(T.edges(spark, sf), rc.anchors(scoped).select("anchor").distinct(), hops=1)
    return q, rc.rank(scoped, q, _closure(spark, sf), spread, _omega(spark, sf))


def _references(spark, sf):
    q = T.queries(spark, sf)
    of = lambda name, df: codes.background_reference(df, q, sample=False).withColumn("source", F.lit(name))
    return of("episodic", T.episodic(spark, sf)).unionByName(of("semantic", T.semantic(spark, sf)))


def _gated(spark, sf):
    q, ranked = _ranked(spark, sf)
    return q, rc.gate(rc.collapse(ranked).join(_references(spark, sf), ["query_id", "source"], "left"), True, CFG)


def _r(c):
    return F.round(c, 6).alias(c)


@query("knn_topk", f"{_knn_sql('k', 'episodic', 10)} SELECT query_id, id, round(distance, 6) AS distance, nth FROM k")
def knn_topk(spark, sf):
    return rc.knn(T.episodic(spark, sf), T.queries(spark, sf), 10).select("query_id", "id", _r("distance"), "nth")


#: What the index of these queries holds: rows created before it was built, one in seven with a vector that has changed since.
_BUILT = T.BEGIN + 1_000_000
_INDEX_SQL = f"i AS (SELECT id, created_at < {_BUILT} AS held, created_at < {_BUILT} AND id % 7 = 3 AS changed FROM episodic)"


def _indexed(spark, sf):
    """The store, the entries of an index that is behind it, and its centroids."""
    store = T.episodic(spark, sf).select("id", "embedding", "created_at")
    then = store.where(F.col("created_at") < _BUILT).withColumn("embedding", F.when(F.col("id") % 7 == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    centroids = vi.fit(then)
    return store.drop("created_at"), cut(vi.assign(then, centroids)), centroids


@query("knn_indexed")  # approximate; a test holds its recall against knn_topk
def knn_indexed(spark, sf):
    store, entries, centroids = _indexed(spark, sf)
    q = T.queries(spark, sf)
    return vi.search(store, entries, vi.calibrated(entries, centroids, q, 10), q, 10).select("query_id", "id", _r("distance"), "nth")


@query("index_pending", f"{_INDEX_SQL} SELECT id, NOT held AS is_new FROM i WHERE NOT held OR changed")
def index_pending(spark, sf):
    store, entries, _ = _indexed(spark, sf)
    waiting = vi.pending(store, entries).select("id")
    return waiting.join(entries.select("id", F.lit(False).alias("_held")), "id", "left").select("id", F.coalesce("_held", F.lit(True)).alias("is_new"))


@query("index_guard", f"""{_INDEX_SQL}, c AS (SELECT count(*) AS n_store, count(*) FILTER (WHERE held) AS n_index, count(*) FILTER (WHERE NOT held OR changed) AS n_pending, count(*) FILTER (WHERE changed) AS n_stale FROM i)
    SELECT 'found' AS state, n_store, n_index, n_pending, n_stale, n_pending + n_stale > 0 AS behind FROM c UNION ALL SELECT 'reconciled', n_store, n_store, 0, 0, false FROM c""")
def index_guard(spark, sf):
    store, entries, centroids = _indexed(spark, sf)
    after = cut(vi.reconciled(store, entries, centroids))
    of = lambda state, e: vi.guard(store, e).select(F.lit(state).alias("state"), "*")
    return of("found", entries).unionByName(of("reconciled", after))


@query("knn_in_session", f"""k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS nth FROM (SELECT q.query_id, e.id, {_DIST} AS distance FROM episodic e JOIN (SELECT * REPLACE ('src' || (query_id // 100 + 1) AS session_id) FROM queries) q USING (session_id)))
    SELECT query_id, id, round(distance, 6) AS distance, nth FROM k WHERE nth <= 4""")
def knn_in_session(spark, sf):
    q = T.queries(spark, sf).withColumn("session_id", F.expr("concat('src', query_id div 100 + 1)"))
    return rc.knn_in_session(T.episodic(spark, sf), q, 4).select("query_id", "id", _r("distance"), "nth")


@query("hybrid_merge", f"{_HYBRID} SELECT query_id, id, source, round(distance, 6) AS distance, nth, leg_order FROM hits")
def hybrid_merge(spark, sf):
    return _hits(spark, sf)[1].select("query_id", "id", "source", _r("distance"), "nth", "leg_order")


@query("drop_counts", f"""{_HYBRID}, r AS (SELECT h.query_id, CASE WHEN NOT coalesce(CASE WHEN h.scope = 'global' THEN true WHEN h.scope = 'session' THEN h.session_id = q.session_id ELSE h.session_id IS NULL OR h.session_id = q.session_id END, false) THEN 'scope'
      WHEN source = 'episodic' AND NOT list_contains(h.tags, 'en') THEN 'tags' END AS reason FROM hits h JOIN queries q USING (query_id))
    SELECT query_id, count(*) AS scanned, count(*) FILTER (WHERE reason = 'scope') AS dropped_by_scope, count(*) FILTER (WHERE reason = 'tags') AS dropped_by_tags FROM r GROUP BY query_id""")
def drop_counts(spark, sf):
    q, hits = _hits(spark, sf)
    h = hits.join(q.select("query_id", F.col("session_id").alias("caller")), "query_id").withColumn("reason", filters.drop_reason(F.col("caller"), F.array(F.lit("en"))))
    return h.groupBy("query_id").agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(F.col("reason") == "scope", 1)).alias("dropped_by_scope"), F.count(F.when(F.col("reason") == "tags", 1)).alias("dropped_by_tags"))


@query("recall_anchor", f"{_HYBRID}, {_CLOSURE}, {_SPREAD} SELECT query_id, anchor FROM anchor")
def recall_anchor(spark, sf):
    return rc.anchors(_scoped(spark, sf)[1])


@query("recall_rank", f"{_HYBRID}, {_CLOSURE}, {_SPREAD} SELECT query_id, id, source, round(rank_key, 6) AS rank_key FROM ranked")
def recall_rank(spark, sf):
    return _ranked(spark, sf)[1].select("query_id", "id", "source", _r("rank_key"))


@query("collapse_groups", f"{_HYBRID}, {_CLOSURE}, {_SPREAD}, {_COLLAPSE} SELECT query_id, id, source, episode_group_id FROM collapsed")
def collapse_groups(spark, sf):
    return rc.collapse(_ranked(spark, sf)[1]).select("query_id", "id", "source", "episode_group_id")


@query("background_reference", f"{_REFS} SELECT query_id, source, round(reference, 6) AS reference FROM refs")
def background_reference(spark, sf):
    return _references(spark, sf).select("query_id", "source", _r("reference"))


@query("background_sample")  # a seeded draw; tests check its size, order and units
def background_sample(spark, sf):
    return codes.background_sample(T.episodic(spark, sf)).select("id", F.transform("unit", lambda x: F.round(x, 6)).alias("unit"))


def _leg(spark, sf):
    q = T.queries(spark, sf)
    hits = rc.knn(T.episodic(spark, sf), q, 32).withColumn("source", F.lit("episodic"))
    return hits.join(_references(spark, sf).where("source = 'episodic'").select("query_id", "reference"), "query_id")


_LEG = f"{_knn_sql('k', 'episodic', 32)}, {_REFS}, leg AS (SELECT k.*, reference FROM k JOIN refs USING (query_id) WHERE source = 'episodic'), {_gate_sql('leg', 'query_id', 'gated')}"


@query("elbow_cutoff", f"""{_knn_sql('k', 'episodic', 32)}, w AS (SELECT *, lag(distance) OVER (PARTITION BY query_id ORDER BY distance) AS before, min(distance) OVER (PARTITION BY query_id) AS lo, max(distance) OVER (PARTITION BY query_id) AS hi, count(*) OVER (PARTITION BY query_id) AS n FROM k),
    d AS (SELECT *, (distance - lo) / (hi - lo) - (nth - 1)::DOUBLE / (n - 1) AS delta FROM w WHERE n >= 3 AND hi - lo >= {CFG.elbow_min_spread})
    SELECT query_id, round(CASE WHEN delta >= {CFG.elbow_sensitivity} AND nth > 1 THEN before END, 6) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY delta DESC, nth) AS r FROM d) WHERE r = 1""")
def elbow_cutoff(spark, sf):
    return rc.elbow(_leg(spark, sf), ["query_id"], CFG).select("query_id", _r("cut"))


@query("dynamic_ceiling", f"{_LEG} SELECT query_id, round(cut, 6) AS cut FROM gated_c")
def dynamic_ceiling(spark, sf):
    return rc.ceiling(_leg(spark, sf), ["query_id"], CFG).select("query_id", _r("cut"))


@query("gap_cutoff", f"{_knn_sql('k', 'episodic', 32)} SELECT query_id, round(min(CASE WHEN nxt - distance >= 0.02 THEN distance END), 6) AS cut FROM (SELECT *, lead(distance) OVER (PARTITION BY query_id ORDER BY distance) AS nxt FROM k) GROUP BY query_id")
def gap_cutoff(spark, sf):
    return rc.gap(_leg(spark, sf), ["query_id"], Config(gap=0.02)).select("query_id", _r("cut"))


@query("gate_relevance", f"{_LEG} SELECT query_id, id, round(distance, 6) AS distance FROM gated")
def gate_relevance(spark, sf):
    return rc.gate(_leg(spark, sf), False, CFG).select("query_id", "id", _r("distance"))


@query("gate_merged", f"{_RECALL} SELECT query_id, id, source, round(distance, 6) AS distance FROM gated")
def gate_merged(spark, sf):
    return _gated(spark, sf)[1].select("query_id", "id", "source", _r("distance"))


def _recall(spark, sf):
    return rc.recall(T.episodic(spark, sf), T.semantic(spark, sf), T.queries(spark, sf), _closure(spark, sf), T.edges(spark, sf), _references(spark, sf), _omega(spark, sf), K, CFG)


@query("recall", f"{_RECALL}, {_TOP} SELECT query_id, position, id, source, round(distance, 6) AS distance, round(greatest(0, least(1, 1 - distance / 2)), 6) AS score FROM topk")
def recall(spark, sf):
    return _recall(spark, sf).select("query_id", "position", "id", "source", _r("distance"), _r("score"))


@query("recall_resource", f"""{_RECALL}, {_TOP} SELECT query_id, CAST(to_json(list({{'position': position, 'id': id, 'source': source, 'distance': CAST(round(distance, 4) AS VARCHAR)}} ORDER BY position)) AS VARCHAR) AS hits FROM topk GROUP BY query_id""")
def recall_resource(spark, sf):
    hit = F.struct("position", "id", "source", F.round("distance", 4).cast("string").alias("distance"))
    return _recall(spark, sf).groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(hit))).alias("hits"))


_SEM = f"""{_knn_sql('k', 'semantic', 32, ', e.kind, e.scope, e.session_id')}, {_REFS},
    leg AS (SELECT k.*, reference FROM k JOIN refs r ON r.query_id = k.query_id AND r.source = 'semantic' JOIN queries q ON q.query_id = k.query_id
      WHERE kind = 'preference' AND CASE WHEN k.scope = 'global' THEN true ELSE k.session_id = q.session_id END), {_gate_sql('leg', 'query_id', 'gated')},
    sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, nth) AS position FROM gated) WHERE position <= 8)"""


def _semantic(spark, sf):
    refs = _references(spark, sf).where("source = 'semantic'").select("query_id", "reference")
    return rc.recall_semantic(T.semantic(spark, sf), T.queries(spark, sf), refs, 8, "preference", CFG)


@query("recall_semantic", f"{_SEM} SELECT query_id, position, id, kind, round(distance, 6) AS distance FROM sem")
def recall_semantic(spark, sf):
    return _semantic(spark, sf).select("query_id", "position", "id", "kind", _r("distance"))


@query("semantic_fallback", f"""{_SEM}, {_knn_sql('e3', 'episodic', 3)}, s AS (SELECT * FROM sem WHERE query_id % 200 = 0)
    SELECT query_id, position, id, round(distance, 6) AS distance, false AS fallback FROM s
    UNION ALL SELECT query_id, nth, id, round(distance, 6), true FROM e3 WHERE query_id NOT IN (SELECT query_id FROM s)""")
def semantic_fallback(spark, sf):
    episodic = rc.knn(T.episodic(spark, sf), T.queries(spark, sf), 3).withColumnRenamed("nth", "position")
    return rc.with_fallback(_semantic(spark, sf).where("query_id % 200 = 0"), episodic).select("query_id", "position", "id", _r("distance"), "fallback")


_DIAG = f"""{_RECALL}, seen AS (SELECT query_id, count(*) AS scanned, min(distance) AS nearest FROM hits GROUP BY query_id), diag AS (
    SELECT s.query_id, (SELECT count(*) FROM episodic) + (SELECT count(*) FROM semantic) AS stored, scanned, round(nearest, 6) AS nearest,
      scanned - (SELECT count(*) FROM scoped c WHERE c.query_id = s.query_id) AS dropped_by_scope, 0 AS dropped_by_tags,
      (SELECT count(*) FROM scoped c WHERE c.query_id = s.query_id) - (SELECT count(*) FROM gated g WHERE g.query_id = s.query_id) AS dropped_by_gate FROM seen s)"""


def _diagnostics(spark, sf):
    q, hits = _hits(spark, sf)
    h = hits.join(q.select("query_id", F.col("session_id").alias("caller")), "query_id").withColumn("drop_reason", filters.drop_reason(F.col("caller"), F.array().cast("array<string>")))
    stored = T.episodic(spark, sf).count() + T.semantic(spark, sf).count()
    return rc.diagnostics(h, q, stored, _gated(spark, sf)[1]).withColumn("nearest", F.round("nearest", 6))


@query("recall_diagnostics", f"{_DIAG} SELECT * FROM diag")
def recall_diagnostics(spark, sf):
    return _diagnostics(spark, sf)


@query("miss_reason", f"""{_DIAG} SELECT query_id, CASE WHEN greatest(dropped_by_scope, dropped_by_tags, dropped_by_gate) = 0 THEN 'no neighbours' WHEN dropped_by_scope >= greatest(dropped_by_tags, dropped_by_gate) THEN 'scope'
    WHEN dropped_by_tags >= dropped_by_gate THEN 'tags' ELSE 'gate' END AS reason FROM diag""")
def miss_reason(spark, sf):
    return rc.miss_reason(_diagnostics(spark, sf)).select("query_id", "reason")


@query("ir_metrics", f"""{_knn_sql('k', 'episodic', 10, ', e.tags, length(e.content) AS chars')}, r AS (SELECT k.*, CASE WHEN list_contains(k.tags, q.topic) THEN 1 ELSE 0 END AS hit FROM k JOIN queries q USING (query_id)),
    p AS (SELECT query_id, coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN nth END), 0) AS mrr, least(1.0::DOUBLE, sum(hit) / 5.0::DOUBLE) AS recall, sum(hit) / 10.0::DOUBLE AS prec, (count(*) - sum(hit))::DOUBLE / count(*) AS irrelevant, sum(chars) AS pack FROM r GROUP BY query_id)
    SELECT round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS precision_at_k, round(avg(irrelevant), 6) AS irrelevant_rate, round(avg(pack), 3) AS pack_chars, count(*) AS n_queries, (SELECT count(*) FROM queries) - count(*) AS n_zero_hits FROM p""")
def ir_metrics(spark, sf):
    from engrama.operators import evaluation as ev

    q = T.queries(spark, sf)
    hits = rc.knn(T.episodic(spark, sf), q, 10, ("tags", "content"))
    return ev.ir_metrics(hits, q, k=10, relevant=5)
