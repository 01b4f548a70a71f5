"""Quality rules: fixed text statistics and a trained classifier of hashed n-grams.

Logistic regression over hashed word 1- and 2-grams and character 3- and 5-grams, each
kind as shares of its own count plus STEADY (so a few words weigh little). It is fitted on a bounded sample of labelled rows
(textmodel.SAMPLE_PER_CLASS of either class), its scores are made probabilities by Platt
scaling on a fifth of the sample that the fit has not seen, at the labels' class sizes, and documents are scored in
Arrow batches against the fixed threshold KEEP. Whole texts count, of any length.

Defined cases: a null or wordless text has zero statistics and fails the base rules;
equal rows get equal results; with no labelled rows of both classes there is no model,
`quality` is null and the base rules alone decide; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textmodel import fit_logistic, fit_platt, grams, labelled_sample, mixed, prior_shift, products, sigmoid, word_hashes, words_of

BITS = 18
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Added to the count of n-grams that shares are taken of.
STEADY = 20
#: Documents of this calibrated probability of good quality or more are kept.
KEEP = 0.3
#: (kind, n, salt, factor)
BLOCKS = (("word", 1, 1, 20.0), ("word", 2, 2, 20.0), ("char", 3, 3, 20.0), ("char", 5, 4, 20.0))
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def repeated_words(words: list[bytes], hashes: np.ndarray, n: int = REPEAT_WINDOW) -> int:
    """How many words lie in n-word windows that the text has twice or more."""
    if len(words) <= n:
        return 0
    keys = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k] + np.uint64(1)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = [tuple(words[i : i + n]) for i in maybe]  # equal hashes are looked at again by the words
    seen = Counter(windows)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(maybe, windows, strict=True):
        if seen[w] > 1:
            steps[i] += 1
            steps[i + n] -= 1
    return int((np.cumsum(steps) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def features(text: str, hashes: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """(buckets, factor) of each block of a text."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return [(mixed(grams(hashes if kind == "word" else chars, n, salt), BITS), factor) for kind, n, salt, factor in BLOCKS]


def logit(model: Model, text: str, hashes: np.ndarray) -> float:
    z = model.bias
    for buckets, factor in features(text, hashes):
        if len(buckets):
            z += factor * float(model.weights[buckets].sum(dtype=np.float64)) / (len(buckets) + STEADY)
    return z


def train(sample: list[tuple[str, int]], sizes: tuple[int, int]) -> Model | None:
    """None without both classes."""
    y = np.array([label for _, label in sample], dtype=float)
    if len(set(y)) < 2:
        return None
    rows, cols, vals = [], [], []
    for i, (text, _) in enumerate(sample):
        for buckets, factor in features(text, word_hashes(words_of(text))):
            found, counts = np.unique(buckets, return_counts=True)
            rows.append(np.full(len(found), i, dtype=np.int32))
            cols.append(found)
            vals.append((factor * counts / (len(buckets) + STEADY)).astype(np.float32))
    rows = np.concatenate(rows)
    cols = np.concatenate(cols)
    vals = np.concatenate(vals)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    share = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * (~held)
    w, b = fit_logistic(rows, cols, vals, y, 1 << BITS, share)
    z = products(rows, cols, vals, w, len(y)) + b
    judge = held if held.any() else ~held
    slope, offset = fit_platt(z[judge], y[judge])
    return Model(w.astype(np.float32), float(b), slope, offset + prior_shift(y[judge], sizes))


def measure(text: str | None, model: Model | None, keep: float = KEEP) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    hashes = word_hashes(words)
    n, word_bytes = len(words), sum(map(len, words))
    chars = len(text or "") - (len(raw) - word_bytes)
    repeat = repeated_words(words, hashes)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    quality = float(sigmoid(model.slope * logit(model, text or "", hashes) + model.offset)) if model else None
    kept = not failed and (quality is None or quality >= keep)
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeat, failed, quality, kept


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """SCHEMA's columns for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                found = [measure(t.as_py(), model, keep) for t in part.column("text")]
                columns = list(zip(*found, strict=True)) if found else [[]] * 8
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SCHEMA)


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Fits the model on labelled rows of docs and scores all of docs."""
    return score(docs, train(*labelled_sample(docs, labels, "quality")), keep)


def keep_good(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of docs that are kept, columns as they are. source: where labelled texts are, if not docs."""
    model = train(*labelled_sample(docs if source is None else source, labels, "quality"))
    columns = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                kept = pa.array([measure(t.as_py(), model, keep)[-1] for t in part.column("text")], pa.bool_())
                yield part.filter(kept)

    return docs.mapInArrow(run, columns)
