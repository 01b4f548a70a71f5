"""Exact nearest neighbours by cosine: a block matrix join over int8 tiles with error bounds.

Every usable vector u (at unit length) is rounded to s * q, with q of bytes and s one step;
e = |u - s q| and r = |s q| are kept with it. For a query x and a row y
    |cos(x, y) - s_x s_y (q_x . q_y)| <= e_x + r_x e_y,
because cos = <u_x - s_x q_x, u_y> + <s_x q_x, u_y - s_y q_y> + s_x s_y (q_x . q_y). A tile is
one product of byte matrices (integers, exact in single precision up to 1,040 components at a
time); whatever may still be among a query's k nearest by these bounds is recomputed from
the original vectors in double precision and goes to the query's heap of k.

Vectors are packed into blocks by the tasks that read them. Row blocks are dealt into bands
and query blocks into query bands; a cell of this grid is one group, and holds at most about
ROW_BAND rows and QUERY_BAND queries, whatever the size of the table. A row is sent once for
each query band, a query once for each row band. k rows a query leave a cell and meet in a
window that keeps k from the start.

Defined cases: vectors that are null, empty, zero or hold a null or not finite component, and
rows without an id, take no part; a query meets rows of its own width and other ids only;
repeated rows each take a rank; of repeated query ids the least vector asks; ties go to the
smaller id; columns beside id and vector are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
ROW_BAND, QUERY_BAND = 32_768, 8_192
#: Small tables are cut finer, into so many bands of rows, of at least so many rows.
LEAST_BANDS, LEAST_ROWS = 16, 2_048
#: Queries of a tile; a tile has BLOCK rows.
QUERY_TILE = 512
#: Components whose products of bytes add up exactly in single precision.
EXACT = (1 << 24) // (127 * 127)
PAIRS = 1 << 15
#: For the rounding of the bounds themselves.
SLACK = 1e-9

BLOCK_SCHEMA = "band long, width int, ids binary, vectors binary, codes binary, measures binary"
FOUND = "query_id long, vec_id long, score double"
_MEASURES = 5  # power of two, norm, step, error, norm of the rounded


def _usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, vectors as they are) of the usable rows, by width."""
    width = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    width = np.where(ids.is_valid().to_numpy(zero_copy_only=False), width, 0)
    for w in np.unique(width[width > 0]):
        at = pa.array(np.flatnonzero(width == w))
        x = vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield int(w), ids.take(at).to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row, and its measures: exact power of two that brings it near one, norm then, step, error, norm of the rounded."""
    power = np.frexp(np.abs(x.astype(np.float64)).max(axis=1))[1]
    y = np.ldexp(x.astype(np.float64), -power[:, None])
    norm = np.sqrt((y * y).sum(axis=1))
    u = y / norm[:, None]
    step = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / step[:, None]).astype(np.int8)
    rounded = codes * step[:, None]
    error = np.sqrt(((u - rounded) ** 2).sum(axis=1))
    return codes, np.column_stack([power, norm, step, error, np.sqrt((rounded**2).sum(axis=1))])


def blocks(df: DataFrame, bands: int, rows: int = BLOCK) -> DataFrame:
    """df(id, vector) packed into blocks of up to `rows` rows of one width, dealt into bands in turn."""
    dtype = np.dtype(np.float32 if dict(df.dtypes)["vector"] == "array<float>" else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def block(width: int) -> pa.RecordBatch:
            nonlocal nth
            nth += 1
            ids, x = (np.concatenate(c) for c in zip(*held.pop(width), strict=True))
            codes, measures = quantised(x)
            row = [nth % bands, width, ids.tobytes(), x.astype(dtype).tobytes(), codes.tobytes(), measures.tobytes()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for width, ids, x in _usable(batch.column("id"), batch.column("vector")):
                for at in range(0, len(ids), rows):
                    held.setdefault(width, []).append((ids[at : at + rows], x[at : at + rows]))
                    if sum(len(i) for i, _ in held[width]) >= rows:
                        yield block(width)
        for width in list(held):
            yield block(width)

    return df.select("id", "vector").mapInArrow(run, BLOCK_SCHEMA)


class Vectors:
    """The blocks of one width, unpacked one after the other."""

    def __init__(self, blocks: pd.DataFrame, dtype: np.dtype):
        width = int(blocks["width"].iloc[0])
        whole = lambda c, kind, shape: np.frombuffer(b"".join(blocks[c]), dtype=kind).reshape(shape)
        self.ids = whole("ids", np.int64, -1)
        self.x = whole("vectors", dtype, (-1, width))
        self.codes = whole("codes", np.int8, (-1, width))
        self.power, self.norm, self.step, self.error, self.rounded = whole("measures", np.float64, (-1, _MEASURES)).T.copy()

    def exact(self, at: np.ndarray) -> np.ndarray:
        return np.ldexp(self.x[at].astype(np.float64), -self.power[at].astype(np.int64)[:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of bytes, exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def bounds(q: Vectors, tile: slice, r: Vectors, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest cosine of each pair of a tile; of a query with its own id none."""
    about = products(q.codes[tile], r.codes[part]) * q.step[tile, None] * r.step[None, part]
    wide = q.error[tile, None] + q.rounded[tile, None] * r.error[None, part] + SLACK
    own = q.ids[tile, None] == r.ids[None, part]
    low, high = about - wide, about + wide
    low[own] = high[own] = -np.inf
    return low, high


def cosines(q: Vectors, i: np.ndarray, r: Vectors, j: np.ndarray) -> np.ndarray:
    """Of pairs, from the original vectors: each pair's by itself, so equal vectors score alike wherever they stand."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        out[at : at + PAIRS] = (q.exact(a) * r.exact(b)).sum(axis=1) / (q.norm[a] * r.norm[b])
    return out


def cell(q: Vectors, r: Vectors, k: int) -> list[list[tuple[float, int]]]:
    """For each query a heap of its k best (score, -id) of the rows."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
    least = np.full(len(q.ids), -np.inf)  # the k-th best score so far
    for first in range(0, len(r.ids), BLOCK):
        part = slice(first, min(first + BLOCK, len(r.ids)))
        for begin in range(0, len(q.ids), QUERY_TILE):
            tile = slice(begin, min(begin + QUERY_TILE, len(q.ids)))
            low, high = bounds(q, tile, r, part)
            need = least[tile]
            if low.shape[1] >= k:
                need = np.maximum(need, np.partition(low, -k, axis=1)[:, -k])
            i, j = np.nonzero((high >= need[:, None]) & (high > -np.inf))
            i, j = i + begin, j + first
            score, ids = cosines(q, i, r, j), r.ids[j]
            order = np.lexsort((ids, -score, i))
            i, score, ids = i[order], score[order], ids[order]
            few = np.arange(len(i)) - np.searchsorted(i, i) < k
            for at, s, row in zip(i[few].tolist(), score[few].tolist(), ids[few].tolist(), strict=True):
                if len(heaps[at]) < k:
                    heapq.heappush(heaps[at], (s, -row))
                else:
                    heapq.heappushpop(heaps[at], (s, -row))
                if len(heaps[at]) == k:
                    least[at] = heaps[at][0][0]
    return heaps


def search(rows: DataFrame, queries: DataFrame, k: int, n_rows: int | None = None, n_queries: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of rows(id, vector) to each of queries(id, vector). n_*: how many there are, if known."""
    queries = queries.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    n_rows = rows.count() if n_rows is None else n_rows
    n_queries = queries.count() if n_queries is None else n_queries
    bands = max(1, ceil(n_rows / ROW_BAND), min(LEAST_BANDS, ceil(n_rows / LEAST_ROWS)))
    query_bands = max(1, ceil(n_queries / QUERY_BAND))
    dtype = np.dtype(np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64)
    keys, cells = ["band", "query_band"], bands * query_bands
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    sent = blocks(rows, bands).select("*", every(query_bands, "query_band"))
    asked = blocks(queries.repartition(query_bands, "id"), query_bands, QUERY_BAND).withColumnRenamed("band", "query_band").select("*", every(bands, "band"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, mine in right.groupby("width"):
            theirs = left[left["width"] == width]
            if len(theirs):
                q = Vectors(mine, dtype)
                for at, heap in enumerate(cell(q, Vectors(theirs, dtype), k)):
                    out += [(q.ids[at], -row, score) for score, row in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    tasks = min(cells, 50_000)  # by number: cells are few and long, so adaptive execution must not merge them by their size
    found = sent.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
