"""Mini-batch k-means on directions, one aggregation a step, and convex hulls of communities."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.operators.nearest import usable
from engrama.operators.vector_index import searchable

#: Rows of a batch, about; steps at most; steps without a better smoothed inertia after which it ends; rows that first centres are drawn from.
BATCH, STEPS, PATIENCE, START = 1024, 40, 6, 8192
_SUMS = "cluster int, n long, inertia double, total array<double>"


def batch(df: DataFrame, step: int, parts: int, seed: int) -> DataFrame:
    """The rows of a step: about one in `parts`, by a hash of seed, step and id, so that a lost task draws them again."""
    return df if parts == 1 else df.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.col("id")), F.lit(parts)) == 0)


def first_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over unit rows: each next centre with a chance by its distance to the ones before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = 1 - x @ x[chosen[0]]
    while len(chosen) < k:
        p = np.maximum(near, 0)
        chosen.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, 1 - x @ x[chosen[-1]])
    return x[chosen]


def moved(centres: np.ndarray, seen: np.ndarray, sums: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """Centres after a batch: each goes toward its rows' mean by their share of all that it has seen (counted up in place)."""
    out = centres.copy()
    for c, (n, total) in sums.items():
        seen[c] += n
        rate = n / seen[c]
        v = (1 - rate) * centres[c] + rate * total / n
        out[c] = v / norm if (norm := np.linalg.norm(v)) > 1e-12 else centres[c]
    return out


def _sums(df: DataFrame, centres: np.ndarray) -> list:
    """One row a centre that has rows: their number, their distances to it and their sum."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, inertia, total = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres)), np.zeros_like(centres)
        for pdf in batches:
            x = usable(pdf["embedding"].tolist())[1].get(centres.shape[1])
            if x is not None:
                d = 1 - x @ centres.T
                of = d.argmin(axis=1)
                np.add.at(n, of, 1)
                np.add.at(inertia, of, d[np.arange(len(of)), of])
                np.add.at(total, of, x)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "inertia": inertia[some], "total": list(total[some])})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "n": [pdf["n"].sum()], "inertia": [pdf["inertia"].sum()], "total": [np.sum(np.stack(pdf["total"].to_list()), axis=0)]})

    return df.select("embedding").mapInPandas(part, _SUMS).groupBy("cluster").applyInPandas(joined, _SUMS).orderBy("cluster").collect()  # k rows


def fit(df: DataFrame, k: int, seed: int = 0, size: int = BATCH, steps: int = STEPS) -> np.ndarray:
    """k unit centres of df(id, embedding), over the width of most; fewer where there are fewer rows."""
    rows = df.where(searchable())
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return np.zeros((0, 1))
    width, n = widths
    rows = rows.where(F.size("embedding") == width).select("id", "embedding")
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(START).collect()
    centres = first_centres(usable([r.embedding for r in drawn])[1][width], min(k, n), seed)
    parts, seen = max(1, ceil(n / size)), np.zeros(len(centres), dtype=np.int64)
    smooth, best, waited = None, np.inf, 0
    pull = min(1.0, 2 * size / (n + 1))  # as much of the whole as a batch is
    for step in range(steps):
        found = _sums(batch(rows, step, parts, seed), centres)
        if not found:
            continue
        mean = sum(r.inertia for r in found) / sum(r.n for r in found)
        if parts == 1:  # every batch is all rows, so each step is a full one
            seen[:] = 0
        centres = moved(centres, seen, {r.cluster: (r.n, np.array(r.total)) for r in found})
        smooth = mean if smooth is None else (1 - pull) * smooth + pull * mean
        waited = 0 if smooth < best - 1e-4 else waited + 1
        best = min(best, smooth)
        if waited >= (1 if parts == 1 else PATIENCE):
            break
    return centres


def assigned(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """df's rows of the centres' width with their `cluster`, the first of equally near ones."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, cluster int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, rows = usable(pdf["embedding"].tolist())
            if len(centres) and centres.shape[1] in rows:
                yield pdf.iloc[places[centres.shape[1]]].assign(cluster=(rows[centres.shape[1]] @ centres.T).argmax(axis=1).astype(np.int32))

    return df.where(searchable()).mapInPandas(run, schema)


# hulls

#: Points around a node that stand for its disc; parts that a community's points are first reduced in.
DISC_STEPS, HULL_PARTS = 8, 16


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise from the least (x, y); points within an edge are none."""
    p = np.unique(np.column_stack([x, y]), axis=0)  # sorted
    if len(p) < 3:
        return p

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def community_hulls(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(community, nth, x, y): the hull of each community of nodes(community, x, y[, r]) that has `least` nodes or more.

    With r, a node stands for DISC_STEPS points around it at that radius. The hull of hulls is
    the hull: each task first reduces what it reads, then parts of a community, then the
    community, so no task sees more of it than hull vertices. Nodes without a finite place
    and null communities are left out.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = nodes.where(F.col("community").isNotNull() & finite("x") & finite("y"))
    some = good.groupBy("community").count().where(F.col("count") >= least).select("community")
    points = good.select("community", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(["r"] if "r" in nodes.columns else [])).join(some, "community", "left_semi")
    if "r" in nodes.columns:
        angle = F.explode(F.array(*[F.lit(2 * np.pi * i / DISC_STEPS) for i in range(DISC_STEPS)])).alias("a")
        r = F.coalesce("r", F.lit(0.0))
        points = points.select("community", "x", "y", r.alias("r"), angle).select("community", (F.col("x") + F.col("r") * F.cos("a")).alias("x"), (F.col("y") + F.col("r") * F.sin("a")).alias("y"))
    kind = nodes.schema["community"].dataType.simpleString()
    schema = f"community {kind}, nth int, x double, y double"

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, mine in pdf.groupby("community", sort=False):
            v = hull(mine["x"].to_numpy(), mine["y"].to_numpy())
            out.append(pd.DataFrame({"community": c, "nth": np.arange(len(v), dtype=np.int32), "x": v[:, 0], "y": v[:, 1]}))
        return pd.concat(out) if out else pd.DataFrame({"community": [], "nth": [], "x": [], "y": []})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = reduced(pdf if held is None else pd.concat([held[["community", "x", "y"]], pdf]))
        if held is not None and len(held):
            yield held

    parts = points.select("community", "x", "y").mapInPandas(read, schema)
    part = F.pmod(F.xxhash64("x", "y"), F.lit(HULL_PARTS)).alias("part")
    parts = parts.select("community", part, "x", "y").groupBy("community", "part").applyInPandas(lambda pdf: reduced(pdf), schema)
    return parts.select("community", "x", "y").groupBy("community").applyInPandas(lambda pdf: reduced(pdf), schema)
