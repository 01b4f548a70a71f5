"""Scans, changes, filters and projections over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.config import Config
from engrama.functions import text as tx
from engrama.functions import vectors as vx
from engrama.operators import copies, filters, store
from engrama.operators.shared import cut
from engrama.sources import tables as T
from engrama.sources.log_source import NAME as LOG_SOURCE
from engrama.sources.log_source import LogSource

from .registry import query

NOW = T.NOW


@query("scan_page", "SELECT id, session_id, created_at FROM episodic WHERE session_id IN ('src1', 'src2', 'src3') ORDER BY id LIMIT 20 OFFSET 5")
def scan_page(spark, sf):
    return store.scan_page(T.episodic(spark, sf).select("id", "session_id", "created_at"), {"session_id": ["src1", "src2", "src3"]}, limit=20, offset=5)


@query("scan_window", "SELECT id, salience FROM episodic ORDER BY id LIMIT 100 OFFSET 200")
def scan_window(spark, sf):
    return store.scan_window(T.episodic(spark, sf).select("id", "salience"), 200, 100)[0]


@query("store_counts", "SELECT 'episodic' AS store, count(*) AS n FROM episodic UNION ALL SELECT 'semantic', count(*) FROM semantic UNION ALL SELECT 'edges', count(*) FROM edges")
def store_counts(spark, sf):
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")
    return one("episodic", T.episodic(spark, sf)).union(one("semantic", T.semantic(spark, sf))).union(one("edges", T.edges(spark, sf)))


@query("all_ids", "SELECT id FROM episodic")
def all_ids(spark, sf):
    return T.episodic(spark, sf).select("id")


@query("docs_by_id", "SELECT id, content, tags FROM episodic WHERE id IN (2, 3, 5, 8, 13, 21, 34, 55, 100000)")
def docs_by_id(spark, sf):
    return store.by_ids(T.episodic(spark, sf).select("id", "content", "tags"), [2, 3, 5, 8, 13, 21, 34, 55, 100000])


@query("embeddings_by_id", "SELECT e.id, e.embedding FROM episodic e WHERE e.id IN (SELECT dst_id FROM edges WHERE kind = 'plasticity')")
def embeddings_by_id(spark, sf):
    wanted = T.edges(spark, sf).where("kind = 'plasticity'").selectExpr("dst_id as id")
    return store.by_ids(T.episodic(spark, sf).select("id", "embedding"), wanted)


@query("append_rows", "SELECT id, content FROM semantic UNION ALL SELECT (SELECT max(id) FROM semantic) + row_number() OVER (ORDER BY item_id), text FROM benchmark")
def append_rows(spark, sf):
    base = T.semantic(spark, sf).select("id", "content")
    new = store.next_ids(base, T.raw(spark, sf, "benchmark").selectExpr("item_id", "text as content"), ["item_id"])
    return store.append_rows(base, new.select("id", "content"))


@query("patch_rows", """p AS (SELECT src_id AS id, arg_max(hits, dst_id) AS hits FROM edges GROUP BY src_id)
    SELECT e.id, e.session_id, CASE WHEN p.hits > 5 THEN p.hits ELSE e.retrieval_count END AS retrieval_count FROM episodic e LEFT JOIN (
      SELECT id, hits FROM (SELECT src_id AS id, hits, row_number() OVER (PARTITION BY src_id ORDER BY dst_id DESC) AS r FROM edges WHERE hits > 5) WHERE r = 1) p USING (id)""")
def patch_rows(spark, sf):
    base = T.episodic(spark, sf).select("id", "session_id", F.col("retrieval_count").cast("long").alias("retrieval_count"))
    patch = T.edges(spark, sf).select(F.col("src_id").alias("id"), F.when(F.col("hits") > 5, F.col("hits")).alias("retrieval_count"), F.col("dst_id").alias("seq"))
    return store.patch_rows(base, patch, order="seq")


@query("increment_rows", "SELECT e.id, e.retrieval_count + coalesce(d.n, 0) AS retrieval_count FROM episodic e LEFT JOIN (SELECT ep_id AS id, count(*) AS n FROM accesses GROUP BY 1) d USING (id)")
def increment_rows(spark, sf):
    base = T.episodic(spark, sf).select("id", F.col("retrieval_count").cast("long").alias("retrieval_count"))
    return store.increment_rows(base, T.accesses(spark, sf).select(F.col("ep_id").alias("id"), F.lit(1).alias("delta")), "retrieval_count")


@query("delete_cascade", """gone AS (SELECT id FROM episodic WHERE salience < 0.25)
    SELECT 'doc' AS what, id AS a, 0 AS b FROM episodic WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT kind, src_id, dst_id FROM edges WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone)""")
def delete_cascade(spark, sf):
    docs = T.episodic(spark, sf)
    left, edges = store.delete_cascade(docs.select("id"), T.edges(spark, sf), docs.where("salience < 0.25").select("id"))
    return left.selectExpr("'doc' as what", "id as a", "cast(0 as long) as b").union(edges.select("kind", "src_id", "dst_id"))


@query("edge_scan", "SELECT src_id, dst_id, weight, bonus, hits FROM edges WHERE kind = 'plasticity' AND src_id IN (7, 14, 21, 28, 35)")
def edge_scan(spark, sf):
    return T.edges(spark, sf).where(store.matches({"kind": "plasticity", "src_id": [7, 14, 21, 28, 35]})).select("src_id", "dst_id", "weight", "bonus", "hits")


@query("edge_upsert", """n AS (SELECT 'sr' AS kind, ep_id AS src_id, ep_id % 50 + 300 AS dst_id, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS bonus, count(*) AS hits, max(t) AS last_touch FROM accesses GROUP BY ep_id
      UNION ALL SELECT kind, src_id, dst_id, weight + 1, bonus, hits + 1, last_touch FROM edges WHERE hits > 7)
    SELECT kind, src_id, dst_id, weight, hits, round(last_touch, 3) AS last_touch FROM n
    UNION ALL SELECT kind, src_id, dst_id, weight, hits, round(last_touch, 3) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = e.kind AND n.src_id = e.src_id AND n.dst_id = e.dst_id)""")
def edge_upsert(spark, sf):
    edges = T.edges(spark, sf)
    seen = T.accesses(spark, sf).groupBy("ep_id").agg(F.count(F.lit(1)).alias("hits"), F.max("t").alias("last_touch"))
    new = seen.selectExpr("'sr' as kind", "ep_id as src_id", "ep_id % 50 + 300 as dst_id", "0D as weight", "0D as bonus", "hits", "last_touch")
    new = new.unionByName(edges.where("hits > 7").withColumns({"weight": F.col("weight") + 1, "hits": F.col("hits") + 1}))
    return store.edge_upsert(edges, new).select("kind", "src_id", "dst_id", "weight", "hits", F.round("last_touch", 3).alias("last_touch"))


@query("event_log_tail", "SELECT seq, kind, session_id FROM interaction_log WHERE seq >= (SELECT max(seq) FROM interaction_log) - 512 + 1")
def event_log_tail(spark, sf):
    return store.event_log_tail(T.interaction_log(spark, sf), 512).select("seq", "kind", "session_id")


@query("log_source_tail", "SELECT seq, kind, session_id FROM interaction_log WHERE seq >= (SELECT max(seq) FROM interaction_log) - 512 + 1")
def log_source_tail(spark, sf):
    """The same tail, read by the data source: only the partitions of its range."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = f"{sf}/events.parquet"
    last = T.raw(spark, sf, "events").agg(F.max("event_id").alias("m")).first().m or 0
    e = spark.read.format(LOG_SOURCE).option("path", path).option("key", "event_id").option("pushdown", "true").load().where(F.col("event_id") >= last - 512 + 1)
    return T.logged(e).select("seq", "kind", "session_id")


@query("verified_copy", "SELECT 'episodic' AS store, count(*) AS n, true AS same FROM episodic UNION ALL SELECT 'semantic', count(*), true FROM semantic")
def verified_copy(spark, sf):
    """Each store written, read back and compared by an order-free digest."""
    out = []
    for name, df in (("episodic", T.episodic(spark, sf)), ("semantic", T.semantic(spark, sf))):
        copy = cut(df)
        out.append(copies.digest(df).crossJoin(F.broadcast(copies.digest(copy).toDF("n2", "one2", "two2"))).select(F.lit(name).alias("store"), "n", ((F.col("n") == F.col("n2")) & (F.col("one") == F.col("one2")) & (F.col("two") == F.col("two2"))).alias("same")))
    return out[0].unionByName(out[1])


#: Which embedder the texts of a language go to, in the query below.
_MODELS = {"en": "nomic-embed-text-v1", "de": "intfloat/multilingual-e5-small", "fr": "E_5-large", "es": "all-MiniLM-L6-v2"}


@query("task_prefix", f"""m AS (SELECT doc_id, text, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MODELS.items())} ELSE '' END AS model FROM documents),
    p AS (SELECT *, lower(regexp_replace(model, '[-_./]', '', 'g')) AS b FROM m),
    t AS (SELECT doc_id, text, model, CASE WHEN b LIKE '%nomic%' THEN 'search_document: ' WHEN b LIKE '%e5%' THEN 'passage: ' ELSE '' END AS doc_prefix,
      CASE WHEN b LIKE '%nomic%' THEN 'search_query: ' WHEN b LIKE '%e5%' THEN 'query: ' ELSE '' END AS query_prefix FROM p)
    SELECT doc_id, model, doc_prefix, query_prefix, length(doc_prefix || coalesce(text, '')) AS n_chars FROM t""")
def task_prefix(spark, sf):
    """Each document as its language's embedder gets it: the prefixes by model, and the prefixed text's length."""
    model = F.lit("")
    for lang, name in _MODELS.items():
        model = F.when(F.col("lang") == lang, name).otherwise(model)
    d = T.raw(spark, sf, "documents").select("doc_id", "text", model.alias("model"))
    d = d.select("doc_id", "text", "model", tx.task_prefix(F.col("model"), 0).alias("doc_prefix"), tx.task_prefix(F.col("model"), 1).alias("query_prefix"))
    return d.select("doc_id", "model", "doc_prefix", "query_prefix", F.length(F.concat("doc_prefix", F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"))


@query("scope_filter", "SELECT id, scope, session_id FROM episodic WHERE CASE WHEN scope = 'global' THEN true WHEN scope = 'session' THEN session_id = 'src4' ELSE session_id IS NULL OR session_id = 'src4' END")
def scope_filter(spark, sf):
    return T.episodic(spark, sf).where(filters.visible(F.lit("src4"))).select("id", "scope", "session_id")


@query("resolve_scope", """x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'session' WHEN 2 THEN 'planet' END AS scope, CASE WHEN id % 3 > 0 THEN session_id END AS session_id FROM episodic),
    y AS (SELECT *, CASE WHEN scope NOT IN ('global', 'session') THEN 'unknown scope' WHEN scope IS NULL AND session_id IS NULL THEN 'scope or session_id is needed' WHEN scope = 'session' AND session_id IS NULL THEN 'session scope needs a session_id' END AS error FROM x)
    SELECT id, CASE WHEN error IS NULL THEN coalesce(scope, 'session') END AS resolved, error FROM y""")
def resolve_scope(spark, sf):
    given = T.episodic(spark, sf).selectExpr("id", "case id % 4 when 0 then 'global' when 1 then 'session' when 2 then 'planet' end as scope", "case when id % 3 > 0 then session_id end as session_id")
    scope, session = F.col("scope"), F.col("session_id")
    return given.select("id", filters.resolve_scope(scope, session).alias("resolved"), filters.scope_error(scope, session).alias("error"))


@query("tag_filter", "SELECT id, tags FROM episodic WHERE list_has_all(tags, ['en', 'topic-3'])")
def tag_filter(spark, sf):
    return T.episodic(spark, sf).where(filters.has_tags(F.array(F.lit("en"), F.lit("topic-3")))).select("id", "tags")


@query("kind_filter", "SELECT id, kind FROM semantic WHERE kind = 'decision'")
def kind_filter(spark, sf):
    return T.semantic(spark, sf).where("kind = 'decision'").select("id", "kind")


@query("unconsolidated", "SELECT id, session_id FROM episodic WHERE consolidated_into = 0 AND session_id = 'src7'")
def unconsolidated(spark, sf):
    return filters.unconsolidated(T.episodic(spark, sf), "src7").select("id", "session_id")


@query("eligibility_gate", f"SELECT id, salience, retrieval_count FROM episodic WHERE {NOW} - created_at >= 6000000 AND retrieval_count >= 1 AND salience >= 0.3")
def eligibility_gate(spark, sf):
    return filters.eligible(T.episodic(spark, sf), NOW, Config(min_age_seconds=6_000_000.0)).select("id", "salience", "retrieval_count")


@query("snippet", "SELECT id, length(content) AS content_chars, length(content) > 200 AS truncated, substr(content, 1, 200) AS content FROM episodic")
def snippet(spark, sf):
    return filters.snippet(T.episodic(spark, sf), 200).select("id", "content_chars", "truncated", "content")


@query("content_only", "SELECT id, kind, content FROM semantic")
def content_only(spark, sf):
    return T.semantic(spark, sf).select("id", "kind", "content")


@query("recency_fields", f"""SELECT id, 'episodic' AS source, greatest(last_accessed, coalesce(last_reconsolidated_at, last_accessed)) AS updated_at, round(greatest(0, ({NOW} - created_at) / 86400), 6) AS age_days,
      CASE WHEN segment_count > 1 THEN episode_group_id END AS group_id FROM episodic
    UNION ALL SELECT id, 'semantic', greatest(updated_at, coalesce(last_accessed, updated_at)), round(greatest(0, ({NOW} - created_at) / 86400), 6), NULL FROM semantic""")
def recency_fields(spark, sf):
    e = filters.recency(T.episodic(spark, sf), NOW, True).withColumn("source", F.lit("episodic"))
    s = filters.recency(T.semantic(spark, sf), NOW, False).withColumn("source", F.lit("semantic"))
    cols = ["id", "source", "updated_at", F.round("age_days", 6).alias("age_days")]
    return e.select(*cols, "group_id").union(s.select(*cols, F.lit(None).cast("long")))


@query("preview", r"SELECT id, CASE WHEN length(f) <= 140 THEN f ELSE substr(f, 1, 140) || '…' END AS preview FROM (SELECT id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM episodic)")
def preview(spark, sf):
    return T.episodic(spark, sf).select("id", tx.preview(F.col("content")).alias("preview"))


@query("embedding_payload", "SELECT id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 5)) AS embedding FROM semantic")
def embedding_payload(spark, sf):
    return T.semantic(spark, sf).select("id", vx.rounded("embedding", 5).alias("embedding"))


@query("semantic_detail", "SELECT id, CASE WHEN authored THEN kind ELSE 'fact' END AS kind, coalesce(confidence, 0) AS confidence, tags, len(source_episode_ids) AS n_sources, coalesce(CASE WHEN id % 3 > 0 THEN updated_at END, created_at) AS updated_at FROM semantic")
def semantic_detail(spark, sf):
    s = T.semantic(spark, sf).withColumn("kind", F.when(F.col("authored"), F.col("kind"))).withColumn("updated_at", F.when(F.col("id") % 3 > 0, F.col("updated_at")))
    return s.select("id", F.coalesce("kind", F.lit("fact")).alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "tags", F.size("source_episode_ids").alias("n_sources"), F.coalesce("updated_at", "created_at").alias("updated_at"))


@query("validate_inputs", """SELECT doc_id, CASE WHEN length(trim(content)) = 0 THEN 'content is empty' WHEN length(content) > 5000 THEN 'content is too long' WHEN len(tags) > 3 THEN 'too many tags'
      WHEN length(tags[1]) > 4 THEN 'a tag is too long' WHEN length(session_id) > 4 THEN 'session_id is too long' WHEN k > 1000 THEN 'k is too large' WHEN salience > 1 THEN 'salience is outside 0 to 1' END AS error
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS content, list_resize(['t' || doc_id % 7], doc_id % 5 + 1, 'x') AS tags, source AS session_id, doc_id % 1200 AS k, CAST(doc_id % 25 AS DOUBLE) / 20 AS salience FROM documents)""")
def validate_inputs(spark, sf):
    given = T.raw(spark, sf, "documents").selectExpr("doc_id", "case when doc_id % 11 = 0 then ' ' else text end as content", "concat(array(concat('t', doc_id % 7)), array_repeat('x', cast(doc_id % 5 as int))) as tags", "source as session_id", "doc_id % 1200 as k", "cast(doc_id % 25 as double) / 20 as salience")
    return given.select("doc_id", filters.input_error(given, Config(max_content_chars=5000, max_tags=3, max_tag_chars=4, max_session_id_chars=4)).alias("error"))


@query("normalize_tags", "SELECT id, list_sort(list_distinct(list_filter(list_concat(tags, ['', 'b', 'a', 'b']), lambda t: t <> ''))) AS tags FROM semantic")
def normalize_tags(spark, sf):
    given = F.concat("tags", F.array(F.lit(""), F.lit("b"), F.lit("a"), F.lit("b")))
    return T.semantic(spark, sf).select("id", F.array_sort(F.array_distinct(F.filter(given, lambda t: t != ""))).alias("tags"))
