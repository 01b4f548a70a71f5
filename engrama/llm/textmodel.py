"""Hashed sparse text features, labelled samples and small linear models, trained here."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, per class, at most; of these none longer than
#: SAMPLE_CHARS code points, and no more of them than make SAMPLE_TOTAL code points.
SAMPLE_PER_CLASS, SAMPLE_CHARS, SAMPLE_TOTAL = 1200, 50_000, 12_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """Up to per_class (text, 0/1) rows of each class, in an order fixed by hashing ids; and the sizes of the classes 0 and 1.

    A document labelled both ways, or without a label, an id or a text, is left out. Of
    several texts of one id the least counts; they are reduced to it in the cluster.
    """
    clear = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("y2")).where("y = y2 and y in (0, 1)")
    picked = None
    for y in (0, 1):
        part = clear.where(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sizes = {int(r.y): r["count"] for r in clear.groupBy("y").count().collect()}
    sizes = sizes.get(0, 0), sizes.get(1, 0)
    ids = picked.collect()  # 2 x per_class narrow rows at most
    if not ids:
        return [], sizes
    chosen = docs.sparkSession.createDataFrame(ids, "_id long, y int")
    found = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = found.groupBy("_id", "y").agg(F.min("text").alias("text")).collect()  # 2 x per_class texts at most
    out, total = [], 0
    for r in sorted(rows, key=lambda r: (crc32(str(r["_id"]).encode()), r["_id"])):
        total += len(r.text)
        if total <= SAMPLE_TOTAL:
            out.append((r.text, int(r.y)))
    return out, sizes


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of 32-bit hashes."""
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int32)


def grams(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """32-bit hashes of the n-grams of a sequence of hashes or code points."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint32)
    out = np.full(len(h) - n + 1, salt, dtype=np.uint32)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint32(16777619)
        out ^= out >> np.uint32(15)
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Entries of a sparse matrix taken at a time: bounds what training holds beside the matrix.
TRAIN_BLOCK = 1 << 20


def products(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The sparse matrix times w, for n rows."""
    out = np.zeros(n)
    for at in range(0, len(rows), TRAIN_BLOCK):
        part = slice(at, at + TRAIN_BLOCK)
        out += np.bincount(rows[part], weights=vals[part] * w[cols[part]], minlength=n)
    return out


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, weight: np.ndarray, l2: float = 1e-4, rounds: int = 60, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Sparse logistic regression by full-batch Adam: (weights, bias). Rows of weight 0 take no part."""
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    total = weight.sum()
    for t in range(1, rounds + 1):
        r = weight * (sigmoid(products(rows, cols, vals, w, len(y)) + b) - y) / total
        g, gb = l2 * w, r.sum()
        for at in range(0, len(rows), TRAIN_BLOCK):
            part = slice(at, at + TRAIN_BLOCK)
            g = g + np.bincount(cols[part], weights=vals[part] * r[rows[part]], minlength=width)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(slope, offset) that make sigmoid(slope * z + offset) a probability, with Platt's targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(np.abs(z).max(), 1e-9) if len(z) else 1.0
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * x + b)
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a / scale), float(b)


def prior_shift(y: np.ndarray, sizes: tuple[int, int]) -> float:
    """What to add to a log-odds that was calibrated on y, for classes of these sizes."""
    pos, neg = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    return float(np.log((sizes[1] + 1) / (sizes[0] + 1)) - np.log((pos + 1) / (neg + 1)))
