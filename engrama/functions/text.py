"""Text helpers as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Embedding model families and their task prefixes; tool argument aliases.
TASK_PREFIXES = (("nomic", ("search_document: ", "search_query: ")), ("e5", ("passage: ", "query: ")))
ALIASES = {
    "limit": ("k",), "n": ("k",), "top_k": ("k",), "num_results": ("k",), "max_results": ("k",), "count": ("k",),
    "q": ("query",), "text": ("query", "content"), "search": ("query",), "body": ("content",), "memory": ("content",), "id": ("episode_id",),
    "session": ("session_id",), "namespace": ("session_id",), "tag": ("tags",), "labels": ("tags",),
}


def task_prefix(model: Column, side: int) -> Column:
    """The prefix that a model's family wants: side 0 for documents, 1 for queries."""
    bare = F.lower(F.regexp_replace(model, "[-_./]", ""))
    out = None
    for marker, prefixes in TASK_PREFIXES:
        out = F.when(bare.contains(marker), prefixes[side]) if out is None else out.when(bare.contains(marker), prefixes[side])
    return out.otherwise("")


def prefixes(model: str) -> tuple[str, str]:
    """`task_prefix` of a model's name for documents and for queries."""
    bare = model.lower().translate({ord(c): None for c in "-_./"})
    return next((tuple(found) for marker, found in TASK_PREFIXES if marker in bare), ("", ""))


def basename(path: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


# The 32-bit FNV-1a hash, and how many hues there are.
_FNV_START, _FNV_PRIME, HUES = 2166136261, 16777619, 8


def session_hue(session: Column) -> Column:
    """The hue of a session, 0 to HUES - 1: the FNV-1a hash of its UTF-16 units."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(session, "UTF-16BE")), F.lit("(.{4})")), lambda u: F.conv(u, 16, 10).cast("long"))
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(_FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.aggregate(units, F.lit(_FNV_START).cast("long"), step), F.lit(HUES)).cast("int")


def preview(text: Column, n: int = 140) -> Column:
    """White space collapsed, cut to n characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit("…")))


def first_line(text: Column, n: int = 200) -> Column:
    """The first line of the trimmed text, n characters at most."""
    bare = F.regexp_replace(text, r"^\s+", "")
    return F.substring(F.regexp_extract(bare, "^[^\\n\\r\\x0B\\x0C\\x1C-\\x1E]*", 0), 1, n)


def format_duration(seconds: Column) -> Column:
    """42s, 7m, 1h 02m, 2d 04h: the two largest units; a dash for what is not a duration."""
    s = F.floor(seconds)
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    pair = lambda big, unit, rest, small: F.concat(big.cast("string"), F.lit(unit), F.when(rest > 0, F.concat(F.lit(" "), F.lpad(rest.cast("string"), 2, "0"), F.lit(small))).otherwise(""))
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), "—")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m")))
        .when(h < 24, pair(h, "h", m % 60, "m"))
        .otherwise(pair(d, "d", h % 24, "h"))
    )


def relative_time(seconds: Column) -> Column:
    """Seconds ago on the ladder s, m, h, d, mo, y."""
    s = F.floor(seconds)
    ladder = F.when(seconds < 0, F.lit("now")).when(s < 45, F.concat(s.cast("string"), F.lit("s")))
    for size, below, unit in ((60, 3600, "m"), (3600, 86_400, "h"), (86_400, 30 * 86_400, "d"), (30 * 86_400, 360 * 86_400, "mo")):
        ladder = ladder.when(s < below, F.concat(F.floor(s / size).cast("string"), F.lit(unit)))
    return ladder.otherwise(F.concat(F.floor(s / (360 * 86_400)).cast("string"), F.lit("y")))


def split_scalar_list(value: Column) -> Column:
    """A list from a JSON array, or by commas, or by white space."""
    t = F.trim(value)
    parsed = F.from_json(t, "array<string>")
    parts = F.when(t.startswith("[") & parsed.isNotNull() & t.endswith("]"), parsed).when(t.contains(","), F.split(t, ",")).otherwise(F.split(t, r"\s+"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").lower()


def resolve_arguments(given: dict, known: set[str]) -> dict:
    """Renames aliased and camel-case arguments to known ones; two values for one argument are an error."""
    out = {}
    for name, value in given.items():
        target = name
        if name not in known:
            snake = snake_case(name)
            target = next((c for c in (snake, *ALIASES.get(snake, ())) if c in known), name)
        if target in out:
            raise ValueError(f"more than one argument means {target}")
        out[target] = value
    return out


_BOUNDARY = r"(?<=[.!?])(\s+)(?=[A-Z(\"'])"


def sentence_pieces(text: Column) -> Column:
    """Sentences with the white space after them; joined, they are the text."""
    return F.filter(F.split(F.regexp_replace(text, _BOUNDARY, "$1\u0001"), "\u0001"), lambda p: p != "")


def pack(content: str, max_chars: int, max_items: int) -> list[str]:
    """Slices of a text whose join is the text: sentences while they fit, overlong ones in windows, surplus in the last."""
    if max_chars <= 0 or max_items <= 1 or len(content.strip()) <= max_chars:
        return [content]
    ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z(\"'])", content)]
    cuts, start = [0], 0
    for a, b in zip([0, *ends], [*ends, len(content)], strict=True):
        if b - a > max_chars:
            if cuts[-1] != a:
                cuts.append(a)
            cuts.extend(range(a + max_chars, b, max_chars))
            cuts.append(b)
            start = b
        elif b - start > max_chars and a > start:
            cuts.append(a)
            start = a
    cuts = sorted(c for c in {*cuts} if c < len(content))[:max_items]
    return [content[a:b] for a, b in zip(cuts, [*cuts[1:], len(content)], strict=True)]


def segments(df: DataFrame, key: str, text: str, max_chars: int = 1024, max_items: int = 7) -> DataFrame:
    """(key, position, segment) of each row, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s) for k, t in zip(pdf[key], pdf[text], strict=True) for i, s in enumerate(pack(t or "", max_chars, max_items))]
            yield pd.DataFrame(rows, columns=[key, "position", "segment"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, position int, segment string")
