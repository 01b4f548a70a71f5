"""Benchmark decontamination: which words of a corpus lie inside passages of a test set.

Native: DataFrame functions only. The windows of the test set (n consecutive words; a
shorter item is one window) become (a) a table keyed by the window's words and (b) a
bitmap of the hashes of their first words. One scan of the corpus keeps, by the bitmap,
the few positions at which a window may start, spells those windows out, and verifies
them by joining with the table on the words themselves. The only shuffle carries one row
for each document and one for each verified hit.

Defined cases: a null or wordless text has no words and no hits; an item without words
has no window; equal rows each get their own result; a null doc_id is a value like any
other; extra columns of documents are left out of `scan` and kept by `remove_spans`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.vectors import let

from .common import NOT_ALNUM, ROW_KEY, ascii_lower, keyed, materialize, packed, split_words

WINDOW = 10
#: Words that the bitmap looks at.
HEAD = 3
#: Beyond so many windows the table is joined by a shuffle instead of a broadcast.
BROADCAST_WINDOWS = 500_000
#: Bits of the bitmap at most; beyond, it only passes more positions on to the join.
BITMAP_BITS = 1 << 21


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_ALNUM)


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row for each distinct (item_id, window): item_id, window (words, space-joined), len."""
    size = F.size("_w")
    starts = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))))
    return (
        items.select("item_id", words(F.col("text")).alias("_w"))
        .select("item_id", F.least(size, F.lit(n)).alias("len"), "_w", F.explode(starts).alias("_at"))
        .select("item_id", "len", F.array_join(F.slice("_w", F.col("_at"), F.lit(n)), " ").alias("window"))
        .distinct()
    )


def _bucket(ws: list[Column], buckets: int) -> Column:
    return F.pmod(F.hash(*ws), F.lit(buckets))


def _bitmap(windows: DataFrame, head: int, buckets: int) -> Column:
    """A bit for each bucket, as a constant array of longs: 1 if a window's first words fall into it."""
    ws = F.split("window", " ")
    hit = [r[0] for r in windows.select(_bucket([F.element_at(ws, k + 1) for k in range(head)], buckets)).distinct().collect()]
    flags = np.zeros(buckets // 64, dtype=np.uint64)
    for b in hit:
        flags[b >> 6] |= np.uint64(1 << (b & 63))
    return F.split(F.lit(",".join(map(str, flags.view(np.int64).tolist()))), ",").cast("array<bigint>")  # folded once, by the optimizer


def _is_set(flags: Column, bucket: Column) -> Column:
    return F.bit_get(F.element_at(flags, F.shiftright(bucket, 6) + 1), bucket.bitwiseAND(F.lit(63))) == 1


def _windows_at(k: int) -> Column:
    """The windows of k words that start at the likely positions."""
    fits = F.filter("_likely", lambda i: i + (k - 1) <= F.size("_w"))
    return F.transform(fits, lambda i: F.struct(i.alias("at"), F.lit(k).alias("len"), F.array_join(F.slice("_w", i, F.lit(k)), " ").alias("window")))


def verified_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Rows of (doc_id, text_key, n_words, at, len, window): all occurrences of windows.

    `at` counts words from 1. Each input row also yields one row whose `at` is null.
    """
    windows = item_windows(items, n).select("window", "len").distinct()
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # n values at most
    count = windows.count()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("_w"))
    base = base.select("doc_id", "text_key", "_w", F.size("_w").cast("long").alias("n_words"))
    if not lengths:
        return base.select("doc_id", "text_key", "n_words", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("window"))
    head = min(HEAD, lengths[0])
    buckets = min(BITMAP_BITS, 1 << max(12, math.ceil(math.log2(count * 32))))
    flags = _bitmap(windows, head, buckets)
    size = F.size("_w")
    starts = F.when(size >= lengths[0], F.sequence(F.lit(1), size - (lengths[0] - 1))).otherwise(F.array().cast("array<int>"))
    likely = F.filter(starts, lambda i: _is_set(flags, _bucket([F.element_at("_w", i + k) for k in range(head)], buckets)))
    spelt = [_windows_at(k) for k in lengths]
    marker = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("window")))
    rows = (
        base.withColumn("_likely", likely)
        .select("doc_id", "text_key", "n_words", F.explode(F.concat(marker, *spelt)).alias("_h"))
        .select("doc_id", "text_key", "n_words", "_h.at", "_h.len", "_h.window")
    )
    known = windows.select(F.col("window").alias("_window"))
    if count <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    return rows.join(known, F.col("window") == F.col("_window"), "left").where(F.col("at").isNull() | F.col("_window").isNotNull()).drop("_window")


def _covered(spans: Column) -> Column:
    """Words inside a sorted array of (at, len)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["at"] + s["len"])
        return F.struct(end.alias("end"), (acc["n"] + (end - F.greatest(acc["end"], s["at"]))).cast("long").alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans, contaminated."""
    hits = verified_hits(docs, items, n)
    key = ["doc_id", "text_key", "n_words"]
    per_doc = hits.groupBy(*key).agg(
        F.count(F.when(F.col("at").isNull(), 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "len")))).alias("spans"),
        F.collect_set("window").alias("windows"),
    )
    of_window = item_windows(items, n).select(F.col("window").alias("_window"), F.col("item_id").cast("string").alias("_item"))
    per_doc = materialize(per_doc, "decontam")  # a row a document, no text; read twice below
    found = (
        per_doc.select(*key, F.explode("windows").alias("_hit"))
        .join(of_window, F.col("_hit") == F.col("_window"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("_item")).alias("item_ids"))
        .select(*[F.col(c).alias(f"_{c}") for c in key], "item_ids")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_key").eqNullSafe(F.col("_text_key")) & (F.col("n_words") == F.col("_n_words"))
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return (
        per_doc.join(found, same, "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "text_key", "n_words", _covered(F.col("spans")).alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), "spans")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


#: Where a word, A-Z included, meets what separates words.
_BORDER = "(?<=[{0}])(?=[^{0}])|(?<=[^{0}])(?=[{0}])".format("\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F")


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between those words, in time linear in the text and the spans."""
    pieces = F.split(text, _BORDER)
    # the k-th word is piece 2k - 2 from 0, after a leading separator if there is one
    skip = F.when(F.substring(text, 1, 1).rlike("^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"), 1).otherwise(0)
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence((2 * (s["at"] - 1) + skip).cast("int"), (2 * (s["at"] + s["len"] - 2) + skip).cast("int"))))))

    def left(pieces: Column, gone: Column) -> Column:
        last = F.coalesce(F.element_at(gone, -1), F.lit(-1))
        before = lambda d, i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
        gaps = F.transform(gone, lambda d, i: F.array_join(F.slice(pieces, before(d, i) + 2, d - before(d, i) - 1), ""))
        return F.concat(F.array_join(gaps, ""), F.array_join(F.slice(pieces, last + 2, F.greatest(F.size(pieces) - last - 1, F.lit(0))), ""))

    return let(pieces, lambda p: let(gone, lambda g: left(p, g)))


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, mode: str = "documents") -> DataFrame:
    """docs without contamination: mode "documents" drops contaminated rows, "spans" cuts the hit words out.

    Columns and rows without hits stay as they are.
    """
    dirty = keyed(scan(docs, items, n).where("contaminated").select("doc_id", "text_key", "spans")).dropDuplicates(ROW_KEY).select(*ROW_KEY, "spans")
    rows = keyed(packed(docs))
    if mode == "documents":
        return rows.select("row", *ROW_KEY).join(dirty, ROW_KEY, "left_anti").select("row.*")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    cut = F.when(F.col("spans").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("spans")))
    return rows.join(dirty, ROW_KEY, "left").withColumn("row", F.col("row").withField("text", cut)).select("row.*")
