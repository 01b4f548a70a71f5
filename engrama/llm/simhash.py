"""SimHash near-duplicates: fingerprints, their links, and the classes that the links join.

A fingerprint has 8 positional bytes. Two fingerprints within 2 bits differ in 2 bytes at
most, so they share 6 positional bytes or more (the guaranteed minimum). The inverted
index posts each distinct fingerprint under its positional bytes, four at a time: under
the 14 quadruples of positions of a Steiner system, in which each three positions lie in
one quadruple. Of those, 3 avoid any two positions, 7 any one, and 1 at most any three. So
a pair's shared positional bytes can be tallied by the lists that it meets in: 3 meetings
are 6 shared bytes, 7 are 7, and pairs with fewer than 3 share 5 bytes at most and go. The
rest are verified by their differing bits. A list is as selective as 32 bits; posting
single bytes would make lists of 1/256 of all fingerprints, and pairs in the square of the
corpus.

A list of up to LIST_CAP fingerprints yields its pairs. A longer list (a large group of
near copies) is not paired off: each member is posted again under itself and its 32
one-bit changes in the bytes that the list does not fix. Members that meet there are within
2 bits of each other, members within 2 bits always meet, and each meeting has 33 members
at most; it links them to its least. A linked pair meets in 3 lists or more; if one of them
is long, it is linked there, else all its meetings are tallied. So no link between classes
is lost and no group's pairs are spelt out.

Defined cases: a text without words (also null) has fingerprint zero and links like any
other; equal rows share a class; a null doc_id gets a class but never names one, unless
all its class is null; extra columns are ignored by `fingerprints`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, Stored, keyed, materialize, meet, packed

SHINGLE = 3
SEED = 42
MAX_BITS = 2
LIST_CAP = 32
#: Label tables of up to so many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Shingles hashed at a time: bounds memory for very long texts.
BLOCK = 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)  # of each byte, highest first


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    ones = np.zeros((8, 8), dtype=np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        hashes = np.frombuffer(b"".join([digest(join(s), seed) for s in zip(*(part[k:] for k in range(shingle)), strict=False)]), dtype=np.uint8).reshape(-1, 8)
        for b in range(8):
            ones[b] += np.bincount(hashes[:, b], minlength=256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).reshape(-1)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_key for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in part.column("text")], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64()), part.column("text_key")], names=["doc_id", "fp", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_key long")


def _byte(fp: Column, k: int) -> Column:
    return F.shiftright(fp, 8 * (7 - k)).bitwiseAND(F.lit(0xFF))


#: Quadruples of byte positions: the planes of the eight points 000 to 111.
PLANES = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
#: Lists that a pair which differs in two bytes meets in, the guaranteed minimum.
MIN_LISTS = min(sum(not {x, y} & set(q) for q in PLANES) for x, y in combinations(range(8), 2))


def postings(fps: DataFrame) -> DataFrame:
    """(list, fp): each fingerprint under the quadruples of its positional bytes. fps: distinct fp."""
    keys = [F.lit(c << 32) + reduce(add, (_byte(F.col("fp"), k) * (1 << 8 * (3 - i)) for i, k in enumerate(q))) for c, q in enumerate(PLANES)]
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def tallied(short: DataFrame) -> DataFrame:
    """(a, b, n): the pairs a < b that meet in lists (list, fps) and in how many."""
    pairs = short.select("fps", F.posexplode("fps").alias("at", "a")).select("a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, cap: int = LIST_CAP) -> DataFrame:
    """Distinct (a, b), a < b: verified links, enough to join all that links join.

    Between members of lists within the cap all links appear; a longer list's members
    are linked through the least of each meeting.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the index is built for links of up to 2 bits")
    lists = Stored(postings(fps).groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-lists").df
    posted = materialize(postings(fps).join(lists, "list"), "simhash-postings")
    few = posted.where(F.col("n") <= cap).groupBy("list").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = tallied(few).where((F.col("n") >= MIN_LISTS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    combo = F.shiftrightunsigned("list", 32)
    bits = lambda q: F.array(*[F.lit(8 * (7 - k) + i) for k in range(8) if k not in q for i in range(8)])
    free = F.element_at(F.array(*[bits(q) for q in PLANES]), (combo + 1).cast("int"))
    flips = F.transform(free, lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    meetings = (
        posted.where(F.col("n") > cap)
        .select("fp", "list", F.explode(F.concat(F.array("fp"), flips)).alias("meet"))
        .groupBy("list", "meet")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
    )
    return pairs.unionByName(meetings).distinct()


def components(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root): the least node of the connected component of each node that has an edge.

    Alternates the large-star and small-star steps until the stars stand still. Each step
    takes the least neighbour of each node by an aggregation (combined before the shuffle)
    and hands it to the node's edges by a join with that narrow table.
    """
    stars = Stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = stars.df.union(stars.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        rows = least.df.count()
        large = Stored(_join(both, least.df, rows, broadcast_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = Stored(large.df.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = _join(large.df, down.df, rows, broadcast_rows).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        after = Stored(small, "edges")
        state = tuple(after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in (stars, least, large, down):
            old.drop()
        stars = after
        if state == seen:
            break
        seen = state
    root = stars.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())


def _join(edges: DataFrame, least: DataFrame, rows: int, bound: int) -> DataFrame:
    return edges.join(F.broadcast(least) if rows <= bound else least, "u")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, root and component_id of each row of docs.

    root (a fingerprint) names the class, component_id is the least doc_id in it.
    """
    prints = materialize(fingerprints(docs), "simhash-prints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_docs")), "simhash-distinct")
    roots = components(links(fps.select("fp")))
    rooted = materialize(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n_docs").alias("n")).where("n > 1").drop("n"), "simhash-least")
    # a row whose fingerprint nothing shares or links to names its own class
    named = materialize(rooted.select("fp", "root").join(least, "root"), "simhash-named")
    return prints.join(named, "fp", "left").select("doc_id", "text_key", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the least (doc_id, text hash), once; columns stay as they are.

    Rows that agree in both are copies: which of them stays is found by an aggregation that
    is combined before the shuffle, so very many of them do not meet in one task.
    """
    sized = materialize(keyed(classes(docs)).groupBy("root", *ROW_KEY).agg(F.count(F.lit(1)).alias("n")), "simhash-copies")
    kept = materialize(sized.groupBy("root").agg(F.min(F.struct(*ROW_KEY, "n")).alias("k")).select("k.*"), "simhash-kept")
    rows = keyed(packed(docs)).select("row", *ROW_KEY)
    # rows with more copies than that are of fewer than BROADCAST_ROWS keys, and stay out of the shuffle
    often = max(1, (sized.agg(F.sum("n").alias("n")).first().n or 0) // BROADCAST_ROWS)
    rare = rows.join(F.broadcast(sized.where(F.col("n") > often).select(*ROW_KEY)), ROW_KEY, "left_anti")
    single = rare.join(kept.where("n = 1"), ROW_KEY, "left_semi").select("row")
    copies = meet(rows, kept.where("n > 1"), ROW_KEY, BROADCAST_ROWS).groupBy(*ROW_KEY).agg(F.first("row").alias("row"))
    return single.unionByName(copies.select("row")).select("row.*")
