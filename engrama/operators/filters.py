"""Predicates and projections over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config

SCOPES = ("global", "session")


def visible(caller: Column, scope: str = "scope", session: str = "session_id") -> Column:
    """global rows always; session rows to their session; rows without scope if they have no session or the caller's."""
    mine = F.coalesce(F.col(session) == caller, F.lit(False))
    return F.when(F.col(scope) == "global", True).when(F.col(scope) == "session", mine).otherwise(F.col(session).isNull() | mine)


def scope_error(scope: Column, session: Column) -> Column:
    return F.when(scope.isNotNull() & ~scope.isin(*SCOPES), "unknown scope").when(scope.isNull() & session.isNull(), "scope or session_id is needed").when((scope == "session") & session.isNull(), "session scope needs a session_id")


def resolve_scope(scope: Column, session: Column) -> Column:
    """The explicit scope, or session where there is a session_id; null where scope_error says why."""
    return F.when(scope_error(scope, session).isNull(), F.coalesce(scope, F.lit("session")))


def scope_active(scope_session: bool | None, session_id: str | None) -> bool:
    if scope_session and session_id is None:
        raise ValueError("scope_session needs a session_id")
    return scope_session is not False and session_id is not None


def has_tags(required: Column, tags: str = "tags") -> Column:
    return F.size(F.array_except(required, F.coalesce(F.col(tags), F.array().cast("array<string>")))) == 0


def drop_reason(caller: Column, required: Column) -> Column:
    """Why a hit is dropped: scope before tags; tags bind episodic rows only; null if it stays."""
    return F.when(~visible(caller), "scope").when((F.col("source") == "episodic") & ~has_tags(required), "tags")


def created(df_columns: list[str]) -> Column:
    """created_at, or the older name encoded_at."""
    return F.coalesce(*[F.col(c) for c in ("created_at", "encoded_at") if c in df_columns])


def eligible(df: DataFrame, now: float, cfg: Config = DEFAULT) -> DataFrame:
    """Old, retrieved and salient enough to consolidate; a gate of 0 or less is off; unknown age is 0."""
    out = df
    if cfg.min_age_seconds > 0:
        out = out.where(F.lit(now) - F.coalesce("created_at", F.lit(now)) >= cfg.min_age_seconds)
    if cfg.min_retrievals > 0:
        out = out.where(F.coalesce("retrieval_count", F.lit(0)) >= cfg.min_retrievals)
    if cfg.min_salience > 0:
        out = out.where(F.coalesce("salience", F.lit(0.3)) >= cfg.min_salience)
    return out


def unconsolidated(df: DataFrame, session: str | None = None) -> DataFrame:
    out = df.where("consolidated_into = 0")
    return out.where(F.col("session_id") == session) if session is not None else out


def snippet(df: DataFrame, max_chars: int = DEFAULT.snippet_chars, full: bool = False) -> DataFrame:
    """Adds content_chars and truncated; cuts content unless full or max_chars is not positive."""
    n = F.length("content")
    cut = F.lit(False) if full or max_chars <= 0 else n > max_chars
    return df.withColumns({"content_chars": n, "truncated": cut, "content": F.when(cut, F.substring("content", 1, max(max_chars, 0))).otherwise(F.col("content"))})


def recency(df: DataFrame, now: float, episodic: bool) -> DataFrame:
    """updated_at, age_days, and group_id for segments of more than one."""
    stamps = ["last_accessed", "last_reconsolidated_at"] if episodic else ["updated_at", "last_accessed"]
    updated = F.coalesce(F.greatest(*stamps), F.col("created_at"))
    out = df.withColumns({"updated_at": updated, "age_days": F.greatest(F.lit(0.0), (F.lit(float(now)) - F.col("created_at")) / 86_400)})
    return out.withColumn("group_id", F.when(F.coalesce("segment_count", F.lit(1)) > 1, F.col("episode_group_id"))) if episodic else out


def input_error(df: DataFrame, cfg: Config = DEFAULT) -> Column:
    """The first cap that a row's content, tags, session_id, k or salience breaks; null if none. A cap of 0 is off."""
    over = lambda value, cap: (value > cap) if cap > 0 else F.lit(False)
    return (
        F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, "content is empty")
        .when(over(F.length("content"), cfg.max_content_chars), "content is too long")
        .when(over(F.size("tags"), cfg.max_tags), "too many tags")
        .when(F.exists("tags", lambda t: over(F.length(t), cfg.max_tag_chars)), "a tag is too long")
        .when(over(F.length("session_id"), cfg.max_session_id_chars), "session_id is too long")
        .when(over(F.col("k"), cfg.max_recall_k), "k is too large")
        .when((F.col("salience") < 0) | (F.col("salience") > 1) | F.isnan("salience"), "salience is outside 0 to 1")
    )
