"""The engine's tables over the test tables, and the same definitions as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch seconds: when the fixtures begin, and the "now" that queries use.
BEGIN, NOW = 1_704_067_200, 1_712_707_200


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts):
    """Epoch seconds of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1e6")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return raw(spark, sf_dir, "embeddings").join(docs, "vec_id", "left")


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).where("vec_id % 10 = 0")
    return v.selectExpr(
        "vec_id + 1 as id", "coalesce(text, '') as content", "embedding",
        "case label % 4 when 0 then 'fact' when 1 then 'preference' when 2 then 'decision' else 'rule' end as kind",
        "case when label % 4 > 0 then sequence(vec_id + 2, vec_id + 1 + label % 4) else cast(array() as array<bigint>) end as source_episode_ids",
        "case when vec_id % 30 = 0 then array(concat('topic-', label), concat('topic-', (label + 1) % 10)) else array(concat('topic-', label)) end as tags",
        "cast((vec_id * 7) % 11 as double) / 10 as confidence",
        f"cast({BEGIN} + vec_id * 3600 as double) as created_at", f"cast({BEGIN} + vec_id * 3600 + (vec_id % 7) * 3600 as double) as updated_at",
        f"case when vec_id % 20 = 0 then null else cast({BEGIN} + vec_id * 3600 + (vec_id % 11) * 86400 as double) end as last_accessed",
        "vec_id % 20 = 0 as authored", "case when label < 5 then 'global' else 'session' end as scope", "concat('src', vec_id % 20) as session_id",
    )


def episodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).where("vec_id % 10 <> 0")
    return v.selectExpr(
        "vec_id + 1 as id", "coalesce(text, '') as content", "embedding", "concat('src', vec_id % 20) as session_id",
        "case vec_id % 3 when 0 then 'global' when 1 then 'session' end as scope", "array(coalesce(lang, 'xx'), concat('topic-', label)) as tags",
        "0.1 + cast(vec_id % 9 as double) / 10 as salience", f"cast({BEGIN} + vec_id * 3600 as double) as created_at",
        f"cast({BEGIN} + vec_id * 3600 + (vec_id % 5) * 86400 as double) as last_accessed", "cast(vec_id % 7 as int) as retrieval_count",
        f"transform(sequence(0, cast(vec_id % 4 as int)), k -> cast({BEGIN} + vec_id * 3600 + k * 86400 as double)) as access_history",
        "case when vec_id % 4 = 1 then (vec_id div 10) * 10 + 1 else 0 end as consolidated_into",
        "case when vec_id % 10 in (4, 5, 6) then (vec_id div 10) * 10 + 5 end as episode_group_id",
        "case when vec_id % 10 in (4, 5, 6) then cast(vec_id % 10 - 4 as int) end as position_in_episode",
        "case when vec_id % 10 in (4, 5, 6) then 3 else 1 end as segment_count",
        f"case when vec_id % 6 = 0 then cast({BEGIN} + vec_id * 3600 + 5 * 86400 as double) end as last_reconsolidated_at",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return raw(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as vector", "concat('src', vec_id % 20) as session_id", "concat('topic-', label) as topic")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, src_id, dst_id, weight, bonus, hits, last_touch: three edges out of each record."""
    v = raw(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"))
    out = v.select("id", F.explode(F.expr("array(1, 2, 3)")).alias("k")).selectExpr("id", "k", "(id * (k * 2 + 5) + k * 11) % 500 + 1 as dst").where("dst <> id")
    return out.selectExpr(
        "case when k = 3 then 'plasticity' when k = 2 and id % 2 = 0 then 'plasticity' else 'sr' end as kind", "id as src_id", "dst as dst_id",
        "case when k = 3 or (k = 2 and id % 2 = 0) then cast((id * 13 + dst * 7) % 100 as double) / 100 else 0D end as weight",
        "case when k = 3 or (k = 2 and id % 2 = 0) then cast((id + dst) % 10 as double) / 20 else 0D end as bonus",
        "(id * k) % 9 * (case when id % 50 = 1 then 60 else 1 end) + 1 as hits", f"cast({BEGIN} + (id * 7919) % 8000000 as double) as last_touch",
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ep_id, t: the stream of accesses."""
    return raw(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("ep_id"), epoch("ts").alias("t"))


def reinforcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, src_id, dst_id, score, t: keyed by a few record pairs, so that edges see many."""
    e = raw(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("src_id"), (F.col("user_id") % 7 + 40).alias("dst_id"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), epoch("ts").alias("t"))


def interaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, kind, session_id, deduped."""
    return logged(raw(spark, sf_dir, "events"))


def logged(e: DataFrame) -> DataFrame:
    """Rows of events as rows of the log."""
    kind = F.expr("case event_type when 'view' then 'recall' when 'signup' then 'recall_semantic' when 'error' then 'forget' else 'encode' end")
    return e.select(F.col("event_id").alias("seq"), epoch("ts").alias("ts"), kind.alias("kind"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.when(kind == "encode", F.col("event_id") % 2 == 0).alias("deduped"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), (F.col("value") / 1000).alias("seconds"), (F.col("event_type") != "error").alias("ok"))


SUFFIXES = ("\nValueError: bad input", "\n--- a/src/app.py\n+++ b/src/app.py", "\nDone?\n- next `run_task.now` step", " see https://Example.com/a/b.html). We decided to use DataFrame and SparkSession", "\n# Title\n1. first\n```py\nx\n```\npath lib/core/util.rs", '\n{"name": "run", "arguments": {"x": 1}}', "")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents with a structural suffix chosen by id."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return raw(spark, sf_dir, "documents").select("doc_id", F.concat("text", suffix).alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, position, text: the turns of conversations."""
    return raw(spark, sf_dir, "conversations").selectExpr("conv_id as group_id", "turn as position", "text")


_PL = "(k = 3 OR (k = 2 AND id % 2 = 0))"
_SUFFIX_SQL = ", ".join("'" + s.replace("'", "''") + "'" for s in SUFFIXES)
#: The same tables as common table expressions.
SQL = f"""
v AS (SELECT e.*, d.text, d.lang FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
semantic AS (SELECT vec_id + 1 AS id, coalesce(text, '') AS content, embedding,
  CASE label % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'decision' ELSE 'rule' END AS kind,
  CASE WHEN label % 4 > 0 THEN generate_series(vec_id + 2, vec_id + 1 + label % 4) ELSE [] END AS source_episode_ids,
  CASE WHEN vec_id % 30 = 0 THEN ['topic-' || label, 'topic-' || ((label + 1) % 10)] ELSE ['topic-' || label] END AS tags,
  CAST((vec_id * 7) % 11 AS DOUBLE) / 10 AS confidence, CAST({BEGIN} + vec_id * 3600 AS DOUBLE) AS created_at,
  CAST({BEGIN} + vec_id * 3600 + (vec_id % 7) * 3600 AS DOUBLE) AS updated_at,
  CASE WHEN vec_id % 20 = 0 THEN NULL ELSE CAST({BEGIN} + vec_id * 3600 + (vec_id % 11) * 86400 AS DOUBLE) END AS last_accessed,
  vec_id % 20 = 0 AS authored, CASE WHEN label < 5 THEN 'global' ELSE 'session' END AS scope, 'src' || (vec_id % 20) AS session_id
  FROM v WHERE vec_id % 10 = 0),
episodic AS (SELECT vec_id + 1 AS id, coalesce(text, '') AS content, embedding, 'src' || (vec_id % 20) AS session_id,
  CASE vec_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'session' END AS scope, [coalesce(lang, 'xx'), 'topic-' || label] AS tags,
  CAST(0.1 AS DOUBLE) + CAST(vec_id % 9 AS DOUBLE) / 10 AS salience, CAST({BEGIN} + vec_id * 3600 AS DOUBLE) AS created_at,
  CAST({BEGIN} + vec_id * 3600 + (vec_id % 5) * 86400 AS DOUBLE) AS last_accessed, CAST(vec_id % 7 AS INT) AS retrieval_count,
  list_transform(generate_series(0, vec_id % 4), lambda k: CAST({BEGIN} + vec_id * 3600 + k * 86400 AS DOUBLE)) AS access_history,
  CASE WHEN vec_id % 4 = 1 THEN (vec_id // 10) * 10 + 1 ELSE 0 END AS consolidated_into,
  CASE WHEN vec_id % 10 IN (4, 5, 6) THEN (vec_id // 10) * 10 + 5 END AS episode_group_id,
  CASE WHEN vec_id % 10 IN (4, 5, 6) THEN CAST(vec_id % 10 - 4 AS INT) END AS position_in_episode,
  CASE WHEN vec_id % 10 IN (4, 5, 6) THEN 3 ELSE 1 END AS segment_count,
  CASE WHEN vec_id % 6 = 0 THEN CAST({BEGIN} + vec_id * 3600 + 5 * 86400 AS DOUBLE) END AS last_reconsolidated_at
  FROM v WHERE vec_id % 10 <> 0),
queries AS (SELECT vec_id AS query_id, embedding AS vector, 'src' || (vec_id % 20) AS session_id, 'topic-' || label AS topic FROM embeddings WHERE vec_id % 100 = 0),
edges AS (SELECT CASE WHEN {_PL} THEN 'plasticity' ELSE 'sr' END AS kind, id AS src_id, dst AS dst_id,
  CASE WHEN {_PL} THEN CAST((id * 13 + dst * 7) % 100 AS DOUBLE) / 100 ELSE 0.0::DOUBLE END AS weight,
  CASE WHEN {_PL} THEN CAST((id + dst) % 10 AS DOUBLE) / 20 ELSE 0.0::DOUBLE END AS bonus,
  (id * k) % 9 * (CASE WHEN id % 50 = 1 THEN 60 ELSE 1 END) + 1 AS hits, CAST({BEGIN} + (id * 7919) % 8000000 AS DOUBLE) AS last_touch
  FROM (SELECT id, k, (id * (k * 2 + 5) + k * 11) % 500 + 1 AS dst FROM (SELECT vec_id + 1 AS id, unnest([1, 2, 3]) AS k FROM embeddings)) WHERE dst <> id),
accesses AS (SELECT event_id AS seq, user_id AS ep_id, epoch_us(ts) / 1e6 AS t FROM events),
reinforcements AS (SELECT event_id AS seq, user_id % 40 AS src_id, user_id % 7 + 40 AS dst_id, least(1.0::DOUBLE, value / 100) AS score, epoch_us(ts) / 1e6 AS t FROM events),
interaction_log AS (SELECT seq, ts, kind, session_id, CASE WHEN kind = 'encode' THEN seq % 2 = 0 END AS deduped FROM (
  SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, CASE event_type WHEN 'view' THEN 'recall' WHEN 'signup' THEN 'recall_semantic' WHEN 'error' THEN 'forget' ELSE 'encode' END AS kind,
  's' || (user_id % 10) AS session_id FROM events)),
tool_calls AS (SELECT event_id AS seq, event_type AS tool, value / 1000 AS seconds, event_type <> 'error' AS ok FROM events),
decorated AS (SELECT doc_id, text || ([{_SUFFIX_SQL}])[doc_id % {len(SUFFIXES)} + 1] AS text FROM documents),
segments AS (SELECT conv_id AS group_id, turn AS position, text FROM conversations)"""


def sql(body: str) -> str:
    """A query over the engine's tables: body is a SELECT, or further common table expressions and a SELECT."""
    body = body.strip()
    return f"WITH RECURSIVE {SQL.strip()}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
