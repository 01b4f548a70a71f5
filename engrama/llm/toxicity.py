"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - threshold_k) for k = 0, 1, 2 with one weight vector shared
by the ordered thresholds, fitted by the likelihood of each row's grade, which is the
difference of neighbouring probabilities. x holds log(1 + count) of hashed lower-cased
words and of their beginnings (PREFIXES bytes), which inflected languages need. Labels only
say toxic or not, so the grades of toxic rows for the fit are the thirds of their
out-of-fold scores: FOLDS regressions of one threshold each score the toxic rows that they
have not seen. Weights are kept sparse by an L1 proximal step. The sample is bounded
(textmodel.SAMPLE_PER_CLASS a class); every document is scored over its whole text.

Defined cases: a null or empty text has no features (severity is the base rate's); equal
rows get equal results; without labelled rows of both classes there is no model, severity
is null and nothing is toxic; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textmodel import labelled_sample, products, sigmoid

BITS = 20
GRADES = 3
FOLDS = 3
L1, ROUNDS, RATE = 2e-4, 120, 0.1
#: Documents whose P(grade > 0) is this or more are toxic.
TOXIC = 0.5
PREFIXES = (5, 7)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 1 << BITS
    thresholds: np.ndarray  # ascending, GRADES of them


def tokens(text: str | None) -> list[bytes]:
    """Words, and the beginnings of longer words, marked by a leading space."""
    words = _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    return words + [b" " + w[:n] for n in PREFIXES for w in words if len(w) > n]


def buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) & np.uint32((1 << BITS) - 1)


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the features of texts, and the bucket that each column stands for."""
    rows, cols, vals = [], [], []
    for i, text in enumerate(texts):
        found, counts = np.unique(buckets(tokens(text)), return_counts=True)
        rows.append(np.full(len(found), i, dtype=np.int32))
        cols.append(found.astype(np.int64))
        vals.append(np.log1p(counts))
    known, columns = np.unique(np.concatenate(cols), return_inverse=True)
    return np.concatenate(rows), columns, np.concatenate(vals), known


def ordered(first: float, gaps: np.ndarray) -> np.ndarray:
    """Ascending thresholds: the first, and the logarithms of the gaps."""
    return first + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(gaps, -5, 5)))])


def likelihood(z: np.ndarray, y: np.ndarray, first: float, gaps: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the weighted log-likelihood of the grades y, and its gradients by z and by (first, *gaps).

    A row's probability is P(grade > y - 1) - P(grade > y), with 1 below the first
    threshold and 0 above the last.
    """
    above = sigmoid(z[:, None] - ordered(first, gaps)[None, :])
    above = np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1)
    at = np.arange(len(z))
    low, high = above[at, y], above[at, y + 1]
    p = np.maximum(low - high, 1e-12)
    by_z = share * (low + high - 1)  # of the logistic link
    slope = above * (1 - above)
    by_threshold = np.zeros((len(z), above.shape[1]))
    by_threshold[at, y] += share * slope[at, y] / p
    by_threshold[at, y + 1] -= share * slope[at, y + 1] / p
    down = by_threshold[:, 1:-1].sum(axis=0)
    steps = np.exp(np.clip(gaps, -5, 5))
    return float(-(share * np.log(p)).sum()), by_z, np.concatenate([[down.sum()], [down[k + 1 :].sum() * steps[k] for k in range(len(gaps))]])


def descend(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, share: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least loss with an L1 penalty: Adam with a proximal step. Rows of share 0 take no part."""
    top = int(y.max())
    p = np.concatenate([np.zeros(width), [2.0], np.zeros(top - 1)])
    m, v = np.zeros(len(p)), np.zeros(len(p))
    for t in range(1, ROUNDS + 1):
        _, by_z, by_cuts = likelihood(products(rows, cols, vals, p[:width], len(y)), y, p[width], p[width + 1 :], share)
        g = np.concatenate([np.bincount(cols, weights=vals * by_z[rows], minlength=width), by_cuts])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        p = p - scale * m / (1 - 0.9**t)
        cut = np.minimum(L1 * scale[:width], RATE)
        p[:width] = np.sign(p[:width]) * np.maximum(np.abs(p[:width]) - cut, 0)
    return p[:width], ordered(p[width], p[width + 1 :])


def grades(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, toxic: np.ndarray, share: np.ndarray, width: int) -> np.ndarray:
    """0 for clean rows, 1 to GRADES for toxic ones: the thirds of their out-of-fold scores, ties to the lower grade."""
    fold = np.zeros(len(toxic), dtype=int)
    for c in (0, 1):
        fold[toxic == c] = np.arange((toxic == c).sum()) % FOLDS
    z = np.zeros(len(toxic))
    for k in range(FOLDS):
        w, _ = descend(rows, cols, vals, toxic, share * (fold != k), width)
        z[fold == k] = products(rows, cols, vals, w, len(toxic))[fold == k]
    cuts = np.quantile(z[toxic == 1], [(k + 1) / GRADES for k in range(GRADES - 1)])
    return np.where(toxic == 1, 1 + (z[:, None] > cuts[None, :]).sum(axis=1), 0)


def fit(sample: list[tuple[str, int]], sizes: tuple[int, int]) -> Model | None:
    toxic = np.array([label for _, label in sample], dtype=int)
    if len(set(toxic.tolist())) < 2:
        return None
    rows, cols, vals, known = matrix([text for text, _ in sample])
    share = np.where(toxic > 0, sizes[1] / max(1, (toxic > 0).sum()), sizes[0] / max(1, (toxic == 0).sum()))
    share = share / share.sum()
    w, thresholds = descend(rows, cols, vals, grades(rows, cols, vals, toxic, share, len(known)), share, len(known))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[known] = w
    return Model(weights, thresholds)


def probabilities(text: str | None, model: Model) -> np.ndarray:
    """P(grade > k) for k = 0, 1, ..."""
    b = buckets(tokens(text))
    b = b[model.weights[b] != 0]
    z = 0.0
    if len(b):
        found, counts = np.unique(b, return_counts=True)
        z = float((model.weights[found].astype(np.float64) * np.log1p(counts)).sum())
    return sigmoid(z - model.thresholds)


SCHEMA = "doc_id long, p_toxic double, severity double, grade int, toxic boolean"


def score(docs: DataFrame, model: Model | None, toxic: float = TOXIC) -> DataFrame:
    """SCHEMA's columns for each row of docs: severity is the expected grade, grade the likeliest cut."""

    def one(text: str | None) -> tuple:
        if model is None:
            return None, None, 0, False
        p = probabilities(text, model)
        return float(p[0]), float(p.sum()), int((p >= 0.5).sum()), bool(p[0] >= toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.float64(), pa.int32(), pa.bool_()]
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                columns = list(zip(*[one(t.as_py()) for t in part.column("text")], strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def judge(docs: DataFrame, labels: DataFrame, toxic: float = TOXIC) -> DataFrame:
    return score(docs, fit(*labelled_sample(docs, labels, "toxic")), toxic)
