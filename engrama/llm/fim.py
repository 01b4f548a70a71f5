"""Fill-in-the-middle: texts are cut at two code points and their parts put in another order.

Cuts are drawn in code points and made in bytes, by a succinct bit vector over a batch's
UTF-8 bytes: a set bit where a code point begins, packed into 64-bit words, with a directory
of the set bits before each block of eight words. rank(end) - rank(begin) is a text's length
in code points; select at its two ranks gives its byte cuts. Both touch one block a query, so
a batch of texts is cut by a few array operations, whatever the texts' lengths.

Defined cases: a null text counts as empty; empty texts and those that hold a sentinel stay
plain; a null doc_id draws from the seed alone; repeated rows get equal outputs; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 1
#: Of a hundred texts so many stay plain, and so many of the others put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
BLOCK_WORDS = 8
#: Texts cut at a time.
SLICE = 1000
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Boundaries:
    """Rank and select over the places where code points begin in UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        starts = (data & 0xC0) != 0x80
        n_blocks = len(data) // (64 * BLOCK_WORDS) + 1
        bits = np.zeros(n_blocks * BLOCK_WORDS * 8, dtype=np.uint8)
        packed = np.packbits(starts, bitorder="little")
        bits[: len(packed)] = packed
        self.words = bits.view("<u8").reshape(n_blocks, BLOCK_WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points begin before each byte."""
        block = at // (64 * BLOCK_WORDS)
        ahead = np.clip(at[:, None] - 64 * (block[:, None] * BLOCK_WORDS + np.arange(BLOCK_WORDS)), 0, 64)
        mask = np.where(ahead > 0, _ALL >> (64 - np.maximum(ahead, 1)).astype(np.uint64), np.uint64(0))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte where the nth code point (from 0) begins; nth is under the number of code points."""
        block = np.searchsorted(self.before, nth, side="right") - 1
        words = self.words[block]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = nth - self.before[block]
        k = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(nth))
        rest = rest - np.where(k > 0, upto[row, np.maximum(k - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, k]).view(np.uint8).reshape(len(nth), 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return 64 * (block * BLOCK_WORDS + k) + bit


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit integers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def transformed(ids: pa.Array, texts: pa.Array, seed: int, plain_percent: int, spm_percent: int) -> pa.RecordBatch:
    texts = pc.fill_null(texts, "")
    held = pc.match_substring_regex(texts, SENTINEL).to_numpy(zero_copy_only=False)
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    found = Boundaries(data)
    rank = found.rank(ends)
    n = np.diff(rank)
    ids = ids.to_pylist()
    h = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    a, b = np.minimum(one, two), np.maximum(one, two)
    plain = (n == 0) | held | (h[:, 2] % 100 >= 100 - plain_percent)
    spm = h[:, 3] % 100 < spm_percent
    cuts = []
    for units in (a, b):
        at = ends[1:].copy()
        inner = units < n
        at[inner] = found.select((rank[:-1] + units)[inner])
        cuts.append((at - ends[:-1]).tolist())
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for text, x, y, is_plain, is_spm in zip(raw, *cuts, plain.tolist(), spm.tolist(), strict=True):
        t = text.as_py()
        out.append(t if is_plain else b"".join((s, t[y:], p, t[:x], m, t[x:y]) if is_spm else (p, t[:x], s, t[y:], m, t[x:y])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(a, pa.int64(), mask=plain), pa.array(b - a, pa.int64(), mask=plain), pa.array(out, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def transform(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """SCHEMA's columns for each row of docs(doc_id, text, ...): one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                yield transformed(part.column("doc_id"), part.column("text"), seed, plain_percent, spm_percent)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Only sentinels begin with '<' and so on inside one, so the first three are those put in."""
    parts = F.split(output, SENTINEL)
    of = lambda *at: F.concat(*[F.element_at(parts, k) for k in at])
    return F.when(form == "psm", of(2, 4, 3)).when(form == "spm", of(3, 4, 2)).otherwise(output)
