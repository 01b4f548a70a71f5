"""Packing: length buckets of least padding, and token-budget batches inside each bucket.

The exact histogram of all lengths goes to the driver: a row for each length that occurs,
which D rows of D different lengths bound by D * D / 2 <= tokens of the corpus (4.5 million
rows of two numbers for 10^13 tokens, if every length occurs; far fewer in practice).
Dynamic programming over it chooses the boundaries of at most BUCKETS buckets so that
padding every document to its bucket's length costs the fewest tokens; the best cuts move
one way only, so a layer takes D log D steps. Every boundary is a length that occurs.
Inside a bucket documents are numbered without gaps and cut into batches whose padded
tokens keep to the budget.

Defined cases: null and wordless texts have length 0 and are packed like others; a document
longer than the budget is a batch of its own; equal rows get slots of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, gapless_start, materialize, split_words, spread

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows that a cell of the numbering holds, and cells a bucket has at most.
CELL_ROWS, CELLS = 5_000, 4096
_NEVER = 1 << 62


def _layer(best: np.ndarray, edges: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, cut) of the best last bucket over the first j lengths, for each j, where best is the cost without it.

    The least cut that is best never moves back as j grows, so the cuts of all middles of
    a level are looked for between those of their neighbours.
    """
    n = len(edges)
    now, cut = np.full(n + 1, _NEVER), np.zeros(n + 1, dtype=np.int64)
    now[0] = 0
    left, right = np.array([1]), np.array([n])
    low, high = np.array([0]), np.array([n - 1])
    while len(left):
        mid = (left + right) // 2
        many = np.minimum(high, mid - 1) - low + 1
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        of = np.repeat(np.arange(len(mid)), many)
        i = np.arange(len(of)) - first[of] + low[of]
        cost = best[i] - edges[mid - 1][of] * c[i] + t[i]
        least = np.minimum.reduceat(cost, first)
        where = np.flatnonzero(cost == least[of])
        _, at = np.unique(of[where], return_index=True)
        cut[mid] = i[where[at]]
        now[mid] = least + edges[mid - 1] * c[mid] - t[mid]
        left, right, low, high = np.concatenate([left, mid + 1]), np.concatenate([mid - 1, right]), np.concatenate([low, cut[mid]]), np.concatenate([cut[mid], high])
        some = left <= right
        left, right, low, high = left[some], right[some], low[some], high[some]
    return now, cut


def boundaries(lengths: list[int], counts: list[int], tokens: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most `buckets` ranges of ascending lengths, of least padding; ties take the lower end.

    tokens: of all documents at each length. Every range is padded to its upper end.
    """
    n = len(lengths)
    if not n:
        return []
    edges = np.asarray(lengths, dtype=np.int64)
    c, t = (np.concatenate([[0], np.cumsum(np.asarray(x, dtype=np.int64))]) for x in (counts, tokens))
    best = np.full(n + 1, _NEVER)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        best, cut = _layer(best, edges, c, t)
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(edges[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_tokens (words between ASCII white space) of each distinct row, and how many such rows there are: n."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.size(split_words(F.col("text"), ASCII_SPACE)).cast("long").alias("n_tokens"))
    return rows.groupBy("doc_id", "text_key", "n_tokens").agg(F.count(F.lit(1)).alias("n"))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), slot (from 0 in its batch), padding."""
    sized = materialize(lengths(docs), "packing-lengths")
    found = sized.groupBy("n_tokens").agg(F.sum("n").alias("n")).orderBy("n_tokens").toArrow()
    at, n = (found.column(c).to_numpy() for c in ("n_tokens", "n"))
    ends = boundaries(at, n, at * n, buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    placed = sized.withColumn("bucket", bucket)
    placed = placed.withColumn("bucket_len", F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("bucket") + 1).cast("long"))
    numbered = gapless_start(placed, ["bucket"], ["doc_id", "text_key"], min(CELLS, max(64, int(n.sum()) // CELL_ROWS)), "nth")
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return spread(materialize(numbered, "packing-numbers"), "nth").select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("nth") / size).alias("batch"), F.pmod(F.col("nth"), size).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )
