"""Embedders, sparse codes, background samples and pattern completion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config
from engrama.functions import vectors as vx
from engrama.operators.nearest import nearest
from engrama.operators.store import next_ids

#: Re-embedding tolerances: self-search and drift distance, and rows that are embedded anew.
SELF_TOLERANCE, DRIFT_TOLERANCE, VERIFY_ROWS = 0.02, 0.05, 24


def hash_embedder(dim: int) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A loader of an embedder: unit vectors drawn from a generator that the text's hash seeds."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dim).astype(np.float32)
                out[i] = v / np.linalg.norm(v)
            return out

        return run

    return load


def embed(df: DataFrame, column: str, loader: Callable, prefix: str = "", batch: int = 64, char_cap: int = 0) -> DataFrame:
    """Adds `embedding`. The loader runs once for each worker's stream of Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for series in batches:
            texts = [prefix + (t or "") for t in series]
            texts = [t[:char_cap] for t in texts] if char_cap else texts
            rows = []
            for i in range(0, len(texts), batch):
                part = np.asarray(model(texts[i : i + batch]))
                if part.ndim != 2 or len(part) != len(texts[i : i + batch]) or (rows and len(part[0]) != len(rows[0])):
                    raise ValueError(f"the embedder returned an array of shape {part.shape} for {len(texts[i : i + batch])} texts")
                rows += list(part)
            yield pd.Series(rows, dtype=object)

    return df.withColumn("embedding", run(column))


def verify_embeddings(df: DataFrame, column: str, loader: Callable, dim: int, prefix: str = "", char_cap: int = 0) -> DataFrame:
    """One row of checks: rows, rows of a wrong width or not finite or zero, and the largest drift of re-embedded rows."""
    bad = F.col("embedding").isNull() | (F.size("embedding") != dim) | F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | (vx.norm("embedding") == 0)
    checks = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("n_bad"))
    sample = df.orderBy("id").limit(VERIFY_ROWS).withColumnRenamed("embedding", "stored")
    drift = embed(sample, column, loader, prefix, char_cap=char_cap).agg(F.round(F.coalesce(F.max(vx.cosine_distance("stored", "embedding")), F.lit(0.0)), 5).alias("max_drift"))
    return checks.join(drift).withColumn("ok", (F.col("n_bad") == 0) & (F.col("max_drift") <= DRIFT_TOLERANCE))


def projection(dim: int, cfg: Config = DEFAULT) -> np.ndarray:
    rng = np.random.default_rng(cfg.code_seed)
    return (rng.standard_normal((cfg.code_expansion * dim, dim)) / np.sqrt(dim)).astype(np.float32)


def with_support(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds dg_support: the sorted places of the largest activations of a rectified random projection."""

    @F.pandas_udf("array<int>")
    def run(series: pd.Series) -> pd.Series:
        out = []
        w: np.ndarray | None = None
        for v in series:
            if v is None or not len(v):
                out.append(None)
                continue
            x = np.asarray(v, dtype=np.float32)
            if w is None or w.shape[1] != len(x):
                w = projection(len(x), cfg)
            h = np.maximum(w @ x, 0)
            k = max(1, int(cfg.code_sparsity * len(h)))
            out.append(np.sort(np.argpartition(-h, k - 1)[:k]).astype(np.int32))
        return pd.Series(out)

    return df.withColumn("dg_support", run("embedding"))


def with_missing_support(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """df with dg_support, which is worked out only where it is not stored."""
    if "dg_support" not in df.columns:
        return with_support(df, cfg)
    lacks = with_support(df.where("dg_support is null").drop("dg_support"), cfg)
    return df.where("dg_support is not null").unionByName(lacks)


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def background_sample(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A seeded uniform sample of usable unit vectors: (id, unit); no rows from under background_min rows.

    Ids are ordered in the cluster and the drawn places looked up there; only the drawn
    places, background_sample of them, come from the driver.
    """
    spark = df.sparkSession
    ids = df.select("id")
    n = ids.count()
    empty = spark.createDataFrame([], "id long, unit array<double>")
    if cfg.background_sample <= 0 or n < cfg.background_min:
        return empty
    places = sorted(int(i) for i in np.random.default_rng(cfg.background_seed).choice(n, min(cfg.background_sample, n), replace=False))
    drawn = spark.createDataFrame([(p,) for p in places], "place long")
    ranked = next_ids(spark.range(0), ids.select(F.col("id").alias("row")), ["row"]).select("row", (F.col("id") - 1).alias("place"))
    chosen = ranked.join(F.broadcast(drawn), "place", "left_semi").select(F.col("row").alias("id"))
    usable = df.join(F.broadcast(chosen), "id").where(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).where(vx.norm("embedding") > 0)
    return usable.select("id", vx.normalize("embedding").alias("unit"))


def background_reference(df: DataFrame, queries: DataFrame, cfg: Config = DEFAULT, sample: bool = True) -> DataFrame:
    """(query_id, reference): the mean cosine distance of each query to the sample, or to all rows.

    The mean of 1 - x.q over unit vectors x is 1 - mean(x).q: one aggregation, whatever the number of queries.
    """
    units = background_sample(df, cfg).select("unit") if sample else df.select(vx.normalize("embedding").alias("unit"))
    mean = units.select(F.posexplode("unit").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return queries.join(F.broadcast(mean)).where(F.size("mean") == F.size("vector")).select("query_id", (1.0 - vx.dot("mean", vx.normalize("vector"))).alias("reference"))


#: Vectors of a pack, and queries of a tile.
PACK, PACK_TILE = 4096, 1024


def _vector_packs(df: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """Rows as packs (part, nth, width, n, v[, ids]) of up to PACK vectors of a width; what is null or has a null component is of width -1."""
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector)).alias("_v")
    kind = "f8" if df.schema[vector].dataType.elementType.simpleString() != "float" else "f4"
    ids = f", ids array<{df.schema[key].dataType.simpleString()}>" if key else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth, held = TaskContext.get().partitionId(), 0, {}

        def pack(width: int) -> pd.DataFrame:
            rows, keys = held.pop(width)
            return pd.DataFrame({"part": [part], "nth": [nth], "width": [width], "n": [len(rows)], "v": [np.array(rows, dtype=kind).tobytes()]} | ({"ids": [keys]} if key else {}))

        for pdf in batches:
            for v, k in zip(pdf["_v"], pdf[key] if key else pdf["_v"], strict=True):
                width = -1 if v is None else len(v)
                rows, keys = held.setdefault(width, ([], []))
                if width >= 0:
                    rows.append(v)
                if key:
                    keys.append(k)
                if max(len(rows), len(keys)) == PACK:
                    yield pack(width)
                    nth += 1
        for width in list(held):
            yield pack(width)
            nth += 1

    return df.select(whole, *([key] if key else [])).mapInPandas(run, "part long, nth long, width int, n int, v binary" + ids)


def completion_score(df: DataFrame, queries: DataFrame, beta: float = DEFAULT.completion_beta) -> DataFrame:
    """(query_id, score): the smooth maximum of the dot products.

    Packs of rows meet packs of queries, each pair as tiles of one matrix product. A task folds what its packs give
    into a row a query, so rows and queries may both grow: no pair of them leaves a task.
    """
    spark = df.sparkSession
    kind = "f8" if df.schema["embedding"].dataType.elementType.simpleString() != "float" else "f4"
    kind_q = "f8" if queries.schema["vector"].dataType.elementType.simpleString() != "float" else "f4"

    def cell(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, w = np.empty(len(q)), np.empty(len(q))
        for at in range(0, len(q), PACK_TILE):
            s = x @ q[at : at + PACK_TILE].T
            top = s.max(axis=0)
            s -= top
            s *= beta
            m[at : at + PACK_TILE], w[at : at + PACK_TILE] = top, np.where(top == -np.inf, len(x), np.exp(s, out=s).sum(axis=0))
        return m, w

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[tuple[int, int], list] = {}
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for pdf in batches:
                for width, n, v, part, nth, qwidth, qv, ids in zip(pdf["width"], pdf["n"], pdf["v"], pdf["part"], pdf["nth"], pdf["qwidth"], pdf["qv"], pdf["ids"], strict=True):
                    mine = done.setdefault((part, nth), [ids, None])
                    if width != qwidth or width < 0:
                        continue
                    x, q = (np.frombuffer(b, k).reshape(rows, width).astype(np.float64) for b, k, rows in ((v, kind, n), (qv, kind_q, len(ids))))
                    m, w = cell(x, q)
                    if mine[1] is not None:
                        m0, w0 = mine[1]
                        top = np.maximum(m0, m)
                        w = np.where(m0 == top, w0, w0 * np.exp(beta * (m0 - top))) + np.where(m == top, w, w * np.exp(beta * (m - top)))
                        m = top
                    mine[1] = m, w
        for ids, found in done.values():
            m, w = found or (np.full(len(ids), None), np.full(len(ids), None))
            yield pd.DataFrame({"query_id": ids, "m": m, "w": w})

    q = queries.select("query_id", "vector").repartition(max(1, ceil(queries.count() / PACK)))
    q = _vector_packs(q, "vector", "query_id").drop("n").withColumnsRenamed({"width": "qwidth", "v": "qv"})
    rows = _vector_packs(df, "embedding").select("width", "n", "v").repartition(4 * spark.sparkContext.defaultParallelism)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, m double, w double"
    per = rows.crossJoin(q).mapInPandas(run, schema).groupBy("query_id").agg(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("m", "w"))).alias("p"))  # a row a task
    top = per.withColumn("m", F.array_max(F.transform("p", lambda x: x["m"])))
    total = F.aggregate("p", F.lit(0.0), lambda t, x: t + x["w"] * F.exp(beta * (x["m"] - F.col("m"))))
    return top.select("query_id", (F.col("m") + F.log(total) / beta).alias("score"))


def _softmax_mean(df: DataFrame, state: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows x of the queries' width: the shift m, sum exp(beta (x.q - m)) and its weighted sum of x, for each query row of state.

    A task folds its batches into one row a query; these are merged by an aggregation, so the driver gets one row a query.
    """
    n, dim = state.shape

    def fold(a: tuple, b: tuple) -> tuple:
        m = np.maximum(a[0], b[0])
        with np.errstate(invalid="ignore"):
            fa, fb = np.where(np.isfinite(a[0]), np.exp(beta * (a[0] - m)), 0.0), np.where(np.isfinite(b[0]), np.exp(beta * (b[0] - m)), 0.0)
        return m, a[1] * fa + b[1] * fb, a[2] * fa[:, None] + b[2] * fb[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = np.full(n, -np.inf), np.zeros(n), np.zeros((n, dim))
        for pdf in batches:
            rows = [v for v in pdf["embedding"] if v is not None and len(v) == dim and np.isfinite(v).all()]
            for at in range(0, len(rows), 4096):
                x = np.array(rows[at : at + 4096], dtype=np.float64)
                s = x @ state.T
                m = s.max(axis=0)
                w = np.exp(beta * (s - m))
                done = fold(done, (m, w.sum(axis=0), w.T @ x))
        if np.isfinite(done[0]).any():
            yield pd.DataFrame({"q": np.arange(n), "m": done[0], "w": done[1], "x": list(done[2])})

    parts = df.select("embedding").mapInPandas(run, "q int, m double, w double, x array<double>")
    top = parts.groupBy("q").agg(F.max("m").alias("top"))
    scaled = parts.join(F.broadcast(top), "q").withColumn("f", F.exp(F.lit(beta) * (F.col("m") - F.col("top"))))  # a row a query
    sums = scaled.groupBy("q").agg(F.first("top").alias("m"), F.sum(F.col("w") * F.col("f")).alias("w"), *[F.sum(F.get("x", F.lit(i)) * F.col("f")).alias(f"x{i}") for i in range(dim)])
    m, w, total = np.full(n, -np.inf), np.zeros(n), np.zeros((n, dim))
    for r in sums.collect():
        m[r.q], w[r.q], total[r.q] = r.m, r.w, [r[f"x{i}"] for i in range(dim)]
    return m, w, total


def completion_step(df: DataFrame, queries: DataFrame, beta: float = DEFAULT.completion_beta, anchor: float = DEFAULT.completion_anchor) -> DataFrame:
    """(query_id, vector): one softmax recombination, normalise((1 - anchor) q0 + anchor x)."""
    return complete(df, queries, 1, beta, anchor, 0.0)


def complete(df: DataFrame, queries: DataFrame, iters: int, beta: float = DEFAULT.completion_beta, anchor: float = DEFAULT.completion_anchor, least_gain: float = 1e-3) -> DataFrame:
    """(query_id, vector) after up to iters steps: a query stops when its score stands still or its vector vanishes.

    queries is a stated set of one width; its vectors are on the driver, the rows stay in the
    cluster. Null vectors, other widths and values that are not finite are passed over.
    """
    rows = queries.select("query_id", "vector").orderBy("query_id").collect()
    if not rows:
        return queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    dim = max(len(r.vector or ()) for r in rows)
    start = np.array([r.vector if r.vector is not None and len(r.vector) == dim else [0.0] * dim for r in rows], dtype=np.float64)
    state, live, last = start.copy(), np.ones(len(rows), dtype=bool), np.full(len(rows), np.nan)
    for _ in range(iters):
        if not live.any():
            break
        m, w, total = _softmax_mean(df, state, beta)
        if not (w > 0).any():
            break
        live &= w > 0
        score = m + np.log(np.maximum(w, 1e-300)) / beta
        live &= ~(np.abs(score - last) < least_gain)
        last = score
        new = (1 - anchor) * start + anchor * total / np.maximum(w, 1e-300)[:, None]
        length = np.linalg.norm(new, axis=1)
        live &= length > vx.TINY
        state[live] = new[live] / length[live, None]
    return df.sparkSession.createDataFrame([(r.query_id, v.tolist()) for r, v in zip(rows, state, strict=True)], "query_id long, vector array<double>")


def complete_nearest(stores: list[DataFrame], queries: DataFrame, iters: int, k: int, beta: float = DEFAULT.completion_beta, anchor: float = DEFAULT.completion_anchor, least_gain: float = 1e-3) -> DataFrame:
    """queries(query_id, vector[, document]) with `vector` refined over up to iters steps by the k nearest rows of each store.

    A step weighs the unit vectors x of those rows by softmax(beta x.q) and moves on to
    normalise((1 - anchor) q0 + anchor (mean - offset)), where offset leads from the query's
    encoding of its text to the document's (`document`, if given, of the same width and
    finite). A query stops when its score stands still, when its vector vanishes, or when
    nothing is near; a vector that is null, zero or not finite stays as it is.
    """
    if beta <= 0 or not 0 < anchor <= 1 or k <= 0 or least_gain < 0:
        raise ValueError("beta and k are above 0, anchor is in (0, 1], least_gain is not negative")
    state = queries.withColumn("_q", F.when(vx.norm("vector") < float("inf"), vx.unit("vector")))
    offset = vx.space_offset("document", "vector") if "document" in queries.columns else F.lit(None).cast("array<double>")
    state = state.select("query_id", F.col("_q").alias("q0"), F.col("_q").alias("q"), offset.alias("offset"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("live"))
    rows = [r.asDict() for r in state.collect()]  # a stated query set
    schema = "query_id long, q0 array<double>, q array<double>, offset array<double>"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        q0, q, off = np.array(pdf["q0"].iloc[0]), np.array(pdf["q"].iloc[0]), pdf["offset"].iloc[0]
        x = np.array(pdf["x"].tolist())
        s = x @ q
        w = np.exp(beta * (s - s.max()))
        mean = w @ x / w.sum() - (np.array(off) if off is not None else 0)
        new = (1 - anchor) * q0 + anchor * mean
        n = np.linalg.norm(new)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "q": [(new / n).tolist() if n >= vx.TINY else None], "score": [s.max() + np.log(w.sum()) / beta]})

    for _ in range(iters):
        live = [r for r in rows if r["live"] and r["q"] is not None]
        if not live:
            break
        asked = queries.sparkSession.createDataFrame([tuple(r[c] for c in ("query_id", "q0", "q", "offset")) for r in live], schema)
        near = [nearest(df, asked.select("query_id", F.col("q").alias("vector")), k).select("query_id", "id").join(df.select("id", vx.unit("embedding").alias("x")), "id") for df in stores]
        found = {r.query_id: r for r in asked.join(reduce(DataFrame.union, near).drop("id"), "query_id").groupBy("query_id").applyInPandas(step, "query_id long, q array<double>, score double").collect()}
        for r in live:
            new = found.get(r["query_id"])
            r["live"] = new is not None and new.q is not None
            if r["live"]:
                r["live"] = r["score"] is None or abs(new.score - r["score"]) >= least_gain
                r["q"], r["score"] = list(new.q), new.score
    refined = queries.sparkSession.createDataFrame([(r["query_id"], r["q"]) for r in rows], "query_id long, _refined array<double>")
    return queries.join(refined, "query_id").withColumn("vector", F.coalesce("_refined", F.col("vector").cast("array<double>"))).drop("_refined")
