"""Sharding: vector bin packing of groups of equal texts into shards of near equal size.

A group's vector is its bytes, tokens and rows, as shares of a shard's capacity (a shard's
even part of each total). Groups are placed largest first; a group goes where the dot
product of its vector with the shard's residual capacity is highest, among the shards that
it does not overfill by more than SLACK. A group that overfills every shard is too large
to stay whole: it is cut into pieces of at most 1/PIECES of a shard, by the number of the
row in its group, which are placed like groups. No other group is torn apart.

Small groups are packed in two levels: they are dealt to buckets by hash, and in each
bucket placed by the same rule into local bins, one for each shard. The driver places the
local bins, at most BUCKETS x shards of them at any corpus size, together with the groups
that hold over 1/LARGE of one of the three totals (so 3 x LARGE of them at most).

Rows that are equal in id and text are one row with a count until the end, and slots are
prefix sums over counts, so neither a hot group nor repeated rows meet in one task.

Defined cases: a null text has no bytes (size 1) and forms a group with other nulls and
empty texts; equal rows are rows of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, gapless_start, materialize, split_words, spread

SHARDS = 16
#: Buckets: one for each so many groups, within bounds.
GROUPS_A_BUCKET, MIN_BUCKETS, BUCKETS = 1000, 64, 4096
LARGE = 1024
SLACK, PIECES = 0.05, 16
CELL_ROWS, CELLS = 5_000, 4096
GROUP = ["text_key", "size", "tokens", "text_crc32"]


def place(vectors: np.ndarray, counts: list[int], shards: int, capacity: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each group (rows of vectors) its (shard, rows), one entry unless it had to be cut; ties go to the lowest shard and the first group.

    counts: rows that a group can be cut into; 1 for what stays whole.
    """
    items = vectors / np.where(capacity > 0, capacity, 1.0)
    residual = np.ones((shards, items.shape[1]))
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    queue = [(-float(v.max()), i, counts[i], True) for i, v in enumerate(items)]
    heapify(queue)
    while queue:
        _, i, n, whole = heappop(queue)
        v = items[i] * (n / counts[i])
        score = residual @ v
        fits = (v - residual <= SLACK).all(axis=1)
        if whole and n > 1 and not fits.any():
            pieces = min(n, max(2, int(np.ceil(v.max() * PIECES))))
            for k in range(pieces):
                rows = n * (k + 1) // pieces - n * k // pieces
                heappush(queue, (-float(items[i].max() * rows / counts[i]), i, rows, False))
            continue
        b = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        residual[b] -= v
        out[i].append((b, n))
    return out


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, size (UTF-8 bytes plus 1), tokens (words), text_crc32 of each distinct row, and how many such rows there are: n."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.size(split_words(text, ASCII_SPACE)).cast("long").alias("tokens"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return rows.groupBy("doc_id", *GROUP).agg(F.count(F.lit(1)).alias("n"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot (gapless from 0 in its shard) of each row of docs."""
    spark = docs.sparkSession
    base = materialize(vectors(docs), "sharding-rows")
    groups = materialize(base.groupBy(*GROUP).agg(F.sum("n").alias("n")).withColumns({"b": F.col("size") * F.col("n"), "t": F.col("tokens") * F.col("n")}), "sharding-groups")
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    totals = np.array([total.b or 0, total.t or 0, total.n or 0], dtype=float)
    share = F.greatest(*[F.col(c) / F.lit(float(max(1.0, x))) for c, x in zip("btn", totals, strict=True)])
    large = groups.where(share > 1.0 / LARGE).orderBy(*GROUP).collect()  # 3 x LARGE at most: each holds over 1/LARGE of one of three totals
    buckets = int(min(BUCKETS, max(MIN_BUCKETS, total.groups // GROUPS_A_BUCKET)))
    small = groups.where(share <= 1.0 / LARGE).withColumn("bucket", F.pmod(F.xxhash64(*GROUP, F.lit(1)), F.lit(buckets)).cast("int"))

    def locally(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(GROUP, kind="stable")
        v = pdf[["b", "t", "n"]].to_numpy(dtype=float)
        return pdf[[*GROUP, "bucket", "b", "t", "n"]].assign(bin=[p[0][0] for p in place(v, [1] * len(v), shards, v.sum(axis=0) / shards)])

    binned = materialize(small.groupBy("bucket").applyInPandas(locally, "text_key long, size long, tokens long, text_crc32 long, bucket int, b long, t long, n long, bin int"), "sharding-bins")
    bins = binned.groupBy("bucket", "bin").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).orderBy("bucket", "bin").collect()
    items = np.array([[r.b, r.t, r.n] for r in [*large, *bins]], dtype=float).reshape(-1, 3)
    placed = place(items, [*[r.n for r in large], *[1] * len(bins)], shards, totals / shards)
    # (group, lo, hi, shard): the rows from lo up to hi of a large group
    cuts = [(*[r[c] for c in GROUP], lo, lo + k, b) for r, p in zip(large, placed, strict=False) for lo, (b, k) in zip(np.cumsum([0, *[k for _, k in p]]).tolist(), p, strict=False)]
    whole = [c[:4] + c[6:] for r, c in _with_sizes(large, cuts) if c[5] - c[4] == r]
    torn = [c for r, c in _with_sizes(large, cuts) if c[5] - c[4] != r]
    names = "text_key long, size long, tokens long, text_crc32 long"
    shard_of = spark.createDataFrame([(r.bucket, r.bin, p[0][0]) for r, p in zip(bins, placed[len(large) :], strict=True)], "bucket int, bin int, shard int")
    shard_of_small = materialize(binned.join(F.broadcast(shard_of), ["bucket", "bin"]).select(*GROUP, "shard"), "sharding-placed")
    large_keys = F.broadcast(spark.createDataFrame([tuple(r[c] for c in GROUP) for r in large], names))
    columns = ["doc_id", *GROUP, "n", "shard"]
    rows = base.join(large_keys, GROUP, "left_anti").join(shard_of_small, GROUP).select(*columns)
    rows = rows.unionByName(base.join(F.broadcast(spark.createDataFrame(whole, names + ", shard int")), GROUP).select(*columns))
    salts = min(CELLS, max(64, int(totals[2]) // CELL_ROWS))
    if torn:
        piece = spark.createDataFrame(torn, names + ", lo long, hi long, shard int")
        mine = gapless_start(base.join(F.broadcast(piece.select(*GROUP).distinct()), GROUP), GROUP, ["doc_id"], salts, "at")
        inside = mine.join(F.broadcast(piece), GROUP).where((F.col("at") < F.col("hi")) & (F.col("at") + F.col("n") > F.col("lo")))
        inside = inside.withColumn("n", F.least(F.col("at") + F.col("n"), F.col("hi")) - F.greatest("at", "lo"))
        rows = rows.unionByName(inside.groupBy("doc_id", *GROUP, "shard").agg(F.sum("n").alias("n")).select(*columns))
    slots = gapless_start(rows, ["shard"], ["doc_id", "text_key"], salts, "slot")
    return spread(materialize(slots, "sharding-slots"), "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


def _with_sizes(large: list, cuts: list[tuple]) -> list[tuple[int, tuple]]:
    n = {tuple(r[c] for c in GROUP): r.n for r in large}
    return [(n[c[:4]], c) for c in cuts]
