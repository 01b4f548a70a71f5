"""Structural signals of a text as columns: flags, references, length class, salience."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, words and weights that signals are defined by.
DIFF = r"(?m)^(?:---\s|\+\+\+\s|@@|diff --git)"
TRACEBACK = r"(?m)\bTraceback \(most recent call last\)|\b[A-Z][A-Za-z]*Error:|\b[A-Z][A-Za-z]*Exception:|^panic:|\bpanicked at\b"
DECISION = r"(?i)\b(?:decided to|going with|chose to|switching to|instead of|opted for|will use|let's use|we'll use)\b"
TOOL_CALL = r'(?i)"(?:tool|function)"\s*:\s*"[A-Za-z_][\w.-]*"|"name"\s*:\s*"[A-Za-z_][\w.-]*"(?=[^{}]*"(?:arguments|parameters|input)"\s*:)|\btool[_ ]call\b'
QUESTION = r"\?(\s|$)"
STRUCTURED = r"(?m)^(?:#{1,6}[ \t]+\S|[-*+][ \t]+\S|\d+\.[ \t]+\S)"
FENCE = r"(?m)^```[\w+-]*\s*$"
EXTENSIONS = "py|pyi|ts|tsx|js|jsx|rs|go|java|kt|swift|c|cc|cpp|cxx|h|hpp|md|rst|toml|yaml|yml|json|jsonl|sh|bash|zsh|sql|proto|graphql"
FILE_PATH = rf"\b[\w./\\-]+\.(?:{EXTENSIONS})\b"
BACKTICK = r"`([A-Za-z_][A-Za-z0-9_./-]{0,127})`"
CAMEL = r"\b([A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+)\b"
NOISE = ("JavaScript", "TypeScript", "NodeJs", "NodeJS", "MacOS", "MacOs", "PostgreSQL", "MySQL", "GitHub", "GitLab", "OpenAI")
URL = r"(?i)https?://[^\s<>'\"`()]+"
URL_TAIL = ".,;:!?)]}"
ISSUE = r"(?<![A-Za-z0-9_])(?:#\d+|[A-Z]{2,}-\d{2,})(?![A-Za-z0-9_])"
SHORT_BELOW, MEDIUM_BELOW, MAX_REFERENCES, DENSE_REFERENCES = 200, 1500, 100, 3
WEIGHTS = {"has_traceback": 0.30, "has_diff_markers": 0.20, "has_decision_verbs": 0.15, "has_tool_call": 0.05, "has_question": 0.05}
DENSITY_WEIGHT, LONG_WEIGHT = 0.20, 0.05
RESERVED = frozenset(
    "id session_id scope tags salience created_at encoded_at last_accessed retrieval_count access_history consolidated_into dg_support episode_group_id"
    " position_in_episode segment_count drift_total drift_locked last_reconsolidated_at".split()
)


#: In front of a pattern: words, digits, spaces and cases of all scripts, and \\n alone ends a line.
ALL_SCRIPTS = "(?Ud)"


def flags(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    # a plain substring test that each match must pass spares most texts the pattern
    raised = t.contains("Error:") | t.contains("Exception:") | t.contains("panic") | t.contains("Traceback")
    has = lambda pattern: t.rlike(ALL_SCRIPTS + pattern)
    return {
        "has_diff_markers": has(DIFF), "has_traceback": raised & has(TRACEBACK), "has_decision_verbs": has(DECISION), "has_tool_call": (t.contains('"') | F.lower(t).contains("tool")) & has(TOOL_CALL),
        "has_question": t.contains("?") & has(QUESTION), "has_structured_doc": has(STRUCTURED), "code_block_count": F.when(t.contains("```"), F.floor(F.regexp_count(t, F.lit(ALL_SCRIPTS + FENCE)) / 2).cast("int")).otherwise(0),
    }


def length_class(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < SHORT_BELOW, "short").when(n < MEDIUM_BELOW, "medium").otherwise("long")


def references(text: Column) -> Column:
    """Sorted distinct file paths, back-ticked and CamelCase names, URLs and issues; MAX_REFERENCES at most."""
    t = F.coalesce(text, F.lit(""))
    # each pattern runs only where a cheaper test, which every match passes, holds
    every = lambda pattern, may, group=0: F.when(may, F.regexp_extract_all(t, F.lit(ALL_SCRIPTS + pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    paths = F.transform(every(FILE_PATH, t.rlike(rf"\.(?:{EXTENSIONS})\b")), lambda p: F.regexp_replace(p, "^[ab]/", ""))
    camel = F.filter(every(CAMEL, t.rlike("[a-z][A-Z]"), 1), lambda c: ~c.isin(*NOISE))
    urls = F.transform(every(URL, t.contains("://")), lambda u: F.rtrim(u, F.lit(URL_TAIL)))
    found = F.array_union(F.array_union(F.array_union(F.array_union(paths, every(BACKTICK, t.contains("`"), 1)), camel), urls), every(ISSUE, t.rlike(ALL_SCRIPTS + r"[#-]\d")))
    return F.slice(F.array_sort(found), 1, MAX_REFERENCES)


def salience(found: dict[str, Column], refs: Column, length: Column, base: float = 0.3) -> Column:
    total = F.lit(base)
    for name, weight in WEIGHTS.items():
        total = total + F.when(found[name], weight).otherwise(0.0)
    total = total + F.when(F.size(refs) >= DENSE_REFERENCES, DENSITY_WEIGHT).otherwise(0.0) + F.when(length == "long", LONG_WEIGHT).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


@dataclass(frozen=True)
class SignalSpec:
    """A signal of one's own: name, weight in salience, and a function from the text column to a column."""

    name: str
    weight: float
    compute: Callable[[Column], Column]

    def __post_init__(self) -> None:
        if self.name in RESERVED:
            raise ValueError(f"{self.name} is a reserved name")
        if not callable(self.compute):
            raise TypeError("compute takes the text column and returns a column")


def custom(text: Column, specs: list[SignalSpec], base: float = 0.3) -> tuple[dict[str, Column], Column]:
    """Values of the specs, and a salience: a weight counts where its value is true or above zero."""
    values = {s.name: s.compute(text) for s in specs}
    total = F.lit(base)
    for s in specs:
        total = total + F.when(F.coalesce(values[s.name].cast("double"), F.lit(0.0)) > 0, s.weight).otherwise(0.0)
    return values, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
