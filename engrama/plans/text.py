"""Signals, references, segmentation and other text and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.functions import signals as sg
from engrama.functions import text as tx
from engrama.functions import vectors as vx
from engrama.operators import codes
from engrama.sources import tables as T

from .registry import query

_FLAGS_SQL = f"""doc_id, regexp_matches(text, '{sg.DIFF}') AS has_diff_markers, regexp_matches(text, '{sg.TRACEBACK}') AS has_traceback,
  regexp_matches(text, '{sg.DECISION.replace("'", "''")}') AS has_decision_verbs, regexp_matches(text, '(?m)\\?(\\s|$)') AS has_question,
  regexp_matches(text, '{sg.TOOL_CALL.replace("(?=", "").replace(":)|", ":|")}') AS has_tool_call, regexp_matches(text, '{sg.STRUCTURED}') AS has_structured_doc, CAST(len(regexp_extract_all(text, '{sg.FENCE}')) // 2 AS INT) AS code_block_count,
  CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 1500 THEN 'medium' ELSE 'long' END AS length_class, length(text) AS length_chars"""


@query("signals", f"SELECT {_FLAGS_SQL} FROM decorated")
def signals(spark, sf):
    found = sg.flags(F.col("text"))
    return T.decorated(spark, sf).select("doc_id", *[v.alias(k) for k, v in found.items()], sg.length_class(F.col("text")).alias("length_class"), F.length("text").alias("length_chars"))


_NOISE_SQL = ", ".join(f"'{n}'" for n in sg.NOISE)
_URL_SQL = sg.URL.replace("'", "''")
_REFS_SQL = f"""list_sort(list_distinct(flatten([
  list_transform(regexp_extract_all(text, '{sg.FILE_PATH}'), lambda p: regexp_replace(p, '^[ab]/', '')), regexp_extract_all(text, '{sg.BACKTICK}', 1),
  list_filter(regexp_extract_all(text, '{sg.CAMEL}', 1), lambda c: c NOT IN ({_NOISE_SQL})), list_transform(regexp_extract_all(text, '{_URL_SQL}'), lambda u: rtrim(u, '{sg.URL_TAIL}'))])))[:{sg.MAX_REFERENCES}]"""


@query("extract_references", f"SELECT doc_id, {_REFS_SQL} AS refs FROM decorated")
def extract_references(spark, sf):
    return T.decorated(spark, sf).select("doc_id", sg.references(F.col("text")).alias("refs"))


@query("derive_salience", f"""f AS (SELECT *, len({_REFS_SQL}) AS n_refs FROM (SELECT text, {_FLAGS_SQL} FROM decorated))
    SELECT doc_id, round(least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN has_traceback THEN 0.3 ELSE 0 END + CASE WHEN has_diff_markers THEN 0.2 ELSE 0 END + CASE WHEN has_decision_verbs THEN 0.15 ELSE 0 END
      + CASE WHEN has_question THEN 0.05 ELSE 0 END + CASE WHEN has_tool_call THEN 0.05 ELSE 0 END + CASE WHEN n_refs >= 3 THEN 0.2 ELSE 0 END + CASE WHEN length_class = 'long' THEN 0.05 ELSE 0 END), 6) AS salience FROM f""")
def derive_salience(spark, sf):
    text = F.col("text")
    return T.decorated(spark, sf).select("doc_id", F.round(sg.salience(sg.flags(text), sg.references(text), sg.length_class(text)), 6).alias("salience"))


@query("custom_signals", "SELECT doc_id, contains(text, 'DataFrame') AS about_frames, len(string_split(text, ' ')) AS n_words, round(least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN contains(text, 'DataFrame') THEN 0.4 ELSE 0 END + 0.1), 6) AS salience FROM decorated")
def custom_signals(spark, sf):
    specs = [sg.SignalSpec("about_frames", 0.4, lambda t: t.contains("DataFrame")), sg.SignalSpec("n_words", 0.1, lambda t: F.size(F.split(t, " ")))]
    values, salience = sg.custom(F.col("text"), specs)
    return T.decorated(spark, sf).select("doc_id", *[v.alias(k) for k, v in values.items()], F.round(salience, 6).alias("salience"))


@query("sentence_pieces", r"""p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])(\s+)([A-Z("''])', '\1\2' || chr(1) || '\3', 'g'), chr(1)), lambda p: p <> '') AS ps FROM documents)
    SELECT doc_id, CAST(unnest(generate_series(0, len(ps) - 1)) AS INT) AS position, unnest(ps) AS piece FROM p""")
def sentence_pieces(spark, sf):
    return T.raw(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentence_pieces(F.col("text"))).alias("position", "piece"))


@query("segments")  # greedy packing; tests hold it against the join and a slow version
def segments(spark, sf):
    return tx.segments(T.raw(spark, sf, "documents"), "doc_id", "text")


@query("get_episode", "SELECT group_id, string_agg(text, '' ORDER BY position) AS content, count(*) AS segment_count FROM segments GROUP BY group_id")
def get_episode(spark, sf):
    parts = T.segments(spark, sf).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("p"))
    return parts.select("group_id", F.concat_ws("", F.transform("p", lambda x: x["text"])).alias("content"), F.size("p").cast("long").alias("segment_count"))


@query("cosine_distance", "SELECT e.id, q.query_id, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 6) AS distance FROM semantic e, queries q")
def cosine_distance(spark, sf):
    pairs = T.semantic(spark, sf).select("id", "embedding").join(F.broadcast(T.queries(spark, sf).select("query_id", "vector")))
    return pairs.select("id", "query_id", F.round(vx.cosine_distance("embedding", "vector"), 6).alias("distance"))


@query("cosine_score", "SELECT vec_id, round(CASE WHEN d IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - d / 2)) END, 6) AS score FROM (SELECT vec_id, CASE WHEN vec_id % 10 > 0 THEN CAST(vec_id % 50 AS DOUBLE) / 20 END AS d FROM embeddings)")
def cosine_score(spark, sf):
    d = F.expr("case when vec_id % 10 > 0 then cast(vec_id % 50 as double) / 20 end")
    return T.raw(spark, sf, "embeddings").select("vec_id", F.round(vx.score(d), 6).alias("score"))


_NORM_SQL = "list_transform({v}, lambda x: round(x / sqrt(list_inner_product({v}, {v})), 5))"


@query("normalize_vec", f"SELECT vec_id, {_NORM_SQL.format(v='w')} AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS w FROM embeddings)")
def normalize_vec(spark, sf):
    scaled = T.raw(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("w"))
    return scaled.select("vec_id", vx.rounded(vx.normalize("w"), 5).alias("v"))


@query("truncate_vec", f"SELECT vec_id, {_NORM_SQL.format(v='w')} AS v FROM (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS w FROM embeddings)")
def truncate_vec(spark, sf):
    return T.raw(spark, sf, "embeddings").select("vec_id", vx.rounded(vx.truncate("embedding", 16), 5).alias("v"))


@query("space_offset", "SELECT vec_id, list_transform(list_zip(embedding, embedding[2:] || embedding[1:1]), lambda p: round(CAST(p[1] AS DOUBLE) / n - CAST(p[2] AS DOUBLE) / n, 5)) AS v FROM (SELECT vec_id, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def space_offset(spark, sf):
    turned = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    return T.raw(spark, sf, "embeddings").select("vec_id", vx.rounded(vx.space_offset("embedding", turned), 5).alias("v"))


@query("drift_vector", f"""m AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(embedding[2:] || embedding[1:1] AS DOUBLE[])), lambda p: 0.95::DOUBLE * p[1] + 0.05::DOUBLE * p[2]) AS w FROM embeddings)
    SELECT vec_id, {_NORM_SQL.format(v='w')} AS v FROM m""")
def drift_vector(spark, sf):
    cue = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    return T.raw(spark, sf, "embeddings").select("vec_id", vx.rounded(vx.blend("embedding", cue, 0.05), 5).alias("v"))


@query("completion_score", """s AS (SELECT q.query_id, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) AS s FROM episodic e, queries q)
    SELECT query_id, round(max(s) + ln(sum(exp(8 * (s - m)))) / 8, 6) AS score FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM s) GROUP BY query_id""")
def completion_score(spark, sf):
    return codes.completion_score(T.episodic(spark, sf), T.queries(spark, sf)).select("query_id", F.round("score", 6).alias("score"))


@query("ca3_step", """s AS (SELECT q.query_id, CAST(q.vector AS DOUBLE[]) AS q, CAST(e.embedding AS DOUBLE[]) AS x, exp(8 * list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))) AS w FROM episodic e, queries q),
    d AS (SELECT query_id, i, any_value(q[i]) AS q0, sum(w * x[i]) / sum(w) AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM s) GROUP BY query_id, i),
    b AS (SELECT query_id, i, 0.4::DOUBLE * q0 + 0.6::DOUBLE * x AS v FROM d)
    SELECT query_id, list(round(v / n, 5) ORDER BY i) AS vector FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS n FROM b) GROUP BY query_id""")
def ca3_step(spark, sf):
    out = codes.completion_step(T.episodic(spark, sf), T.queries(spark, sf), beta=8.0, anchor=0.6)
    return out.select("query_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@query("ca3_completion")  # iterates; tests hold it against plain NumPy
def ca3_completion(spark, sf):
    out = codes.complete_nearest([T.episodic(spark, sf), T.semantic(spark, sf)], T.queries(spark, sf), iters=3, k=8)
    return out.select("query_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@query("jaccard", "SELECT a.id, b.id AS other, CASE WHEN len(a.tags) = 0 AND len(b.tags) = 0 THEN 1.0 ELSE round(CAST(len(list_intersect(a.tags, b.tags)) AS DOUBLE) / len(list_distinct(list_concat(a.tags, b.tags))), 6) END AS jaccard FROM semantic a JOIN semantic b ON b.id = a.id + 10")
def jaccard(spark, sf):
    s = T.semantic(spark, sf).select("id", "tags")
    other = s.select(F.col("id").alias("other"), F.col("tags").alias("more"))
    return s.join(other, F.col("other") == F.col("id") + 10).select("id", "other", F.round(codes.jaccard(F.col("tags"), F.col("more")), 6).alias("jaccard"))


@query("dg_support")  # a seeded random projection; tests check sizes, order and determinism
def dg_support(spark, sf):
    return codes.with_support(T.episodic(spark, sf).select("id", "embedding")).select("id", "dg_support")


@query("hash_embed")  # hashes seed a generator; tests check norms and equality
def hash_embed(spark, sf):
    return codes.embed(T.raw(spark, sf, "documents").select("doc_id", "text"), "text", codes.hash_embedder(32)).select("doc_id", "embedding")


@query("reembed_verify")
def reembed_verify(spark, sf):
    docs = T.raw(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return codes.verify_embeddings(codes.embed(docs, "content", codes.hash_embedder(32)), "content", codes.hash_embedder(32), 32)


@query("majority_width", "SELECT mode(len(embedding)) AS width, count(*) AS n FROM embeddings")
def majority_width(spark, sf):
    return T.raw(spark, sf, "embeddings").agg(F.mode(F.size("embedding"), True).alias("width"), F.count(F.lit(1)).alias("n"))


@query("format_duration", """d AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN -1.0 ELSE value * (event_id % 5000) END AS s FROM events)
    SELECT event_id, CASE WHEN s < 0 THEN '—' WHEN f < 60 THEN f || 's' WHEN f // 60 < 60 THEN (f // 60) || 'm'
      WHEN f // 3600 < 24 THEN (f // 3600) || 'h' || CASE WHEN f // 60 % 60 > 0 THEN ' ' || lpad(CAST(f // 60 % 60 AS VARCHAR), 2, '0') || 'm' ELSE '' END
      ELSE (f // 86400) || 'd' || CASE WHEN f // 3600 % 24 > 0 THEN ' ' || lpad(CAST(f // 3600 % 24 AS VARCHAR), 2, '0') || 'h' ELSE '' END END AS duration
    FROM (SELECT *, CAST(floor(s) AS BIGINT) AS f FROM d)""")
def format_duration(spark, sf):
    s = F.expr("case when event_id % 13 = 0 then -1D else value * (event_id % 5000) end")
    return T.raw(spark, sf, "events").select("event_id", tx.format_duration(s).alias("duration"))


@query("split_scalar_list", """x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '["' || lang || '", "' || source || '"]' WHEN 1 THEN lang || ' , ' || source || ',' WHEN 2 THEN ' ' || lang || '  ' || source ELSE '' END AS s FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE [replace(replace(regexp_extract(s, '[a-z]+'), '"', ''), ' ', ''), regexp_extract(s, 'src[0-9]+')] END AS parts FROM x""")
def split_scalar_list(spark, sf):
    s = F.expr("case doc_id % 4 when 0 then concat('[\"', lang, '\", \"', source, '\"]') when 1 then concat(lang, ' , ', source, ',') when 2 then concat(' ', lang, '  ', source) else '' end")
    return T.raw(spark, sf, "documents").select("doc_id", tx.split_scalar_list(s).alias("parts"))


@query("session_hue", "SELECT DISTINCT session_id, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(session_id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, u: (xor(h, u) * 16777619) % 4294967296) % 8 AS INT) AS hue FROM interaction_log WHERE session_id IS NOT NULL")
def session_hue(spark, sf):
    return T.interaction_log(spark, sf).where("session_id is not null").select("session_id", tx.session_hue(F.col("session_id")).alias("hue")).distinct()


@query("redacted_path", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def redacted_path(spark, sf):
    return T.raw(spark, sf, "pages").select("page_id", tx.basename(F.col("url")).alias("name"))
