"""Exact ranked lexical search by dual-sorted wavelet trees.

A document's score for an item is the sum, over the item's terms, of weight times impact;
the impact grows with the term's occurrences in the document and falls with its length.
Each task packs the documents that it reads into shards. A shard's postings stand term by
term and, within a term, by falling impact; a wavelet tree over their document numbers (in
the order of doc_id) keeps that order in each of its nodes. So one structure is sorted both
ways: the postings of a term in a node are a range that begins with the greatest impact
there, and the nodes are ranges of doc_id.

A search begins with the root and the term's whole ranges. A node's bound is the sum of
weight times first impact over the ranges that are not empty; expanding a node maps each
range into both children by two ranks. The frontier's best nodes are expanded first, some at
a time; a leaf is one document and its bound the score. A node goes when its bound, or at
the same bound its least doc_id, cannot beat the k-th best so far. That k-th best carries
over from shard to shard of a task, and k documents an item leave a task.

The stated items go in blocks of at most BLOCK_TERMS distinct terms, because every task
holds a block's terms and statistics. Statistics cover all documents.

Defined cases: null texts have no terms; items without terms find nothing; repeated rows
are documents of their own and each take a rank; a null doc_id ranks behind its equals;
equal (item_id, text) rows count once; columns beside the ids and texts are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import Stored

K = 50
#: Documents and postings of a shard at most (one document more than MAX_POSTINGS may hold it alone).
SHARD_DOCS, MAX_POSTINGS = 1 << 14, 1 << 21
#: Distinct terms of the items that are searched for at a time.
BLOCK_TERMS = 1_000_000
#: Nodes expanded at a time.
STEP = 512
SLICE = 1000

#: Bytes to terms: digits, a-z and what is beyond ASCII stay, A-Z are lower-cased, the rest separates.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """tf, n: occurrences of the term in a document, and its terms in all."""
    m = 100 - 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class DualSorted:
    """A shard's postings. ids: doc_id by document number, ascending, NULL_PLACE for null."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, ids: np.ndarray):
        self.ids = ids
        self.levels = max(1, (len(ids) - 1).bit_length())
        order = np.lexsort((doc, -impact, term))
        seq, held = doc[order].astype(np.uint32), impact[order].astype(np.int32)
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        n_words = len(seq) // 64 + 1
        self.words = np.zeros((self.levels, n_words), dtype=np.uint64)
        self.before = np.zeros((self.levels, n_words), dtype=np.int32)
        self.impact = np.empty((self.levels + 1, len(seq)), dtype=np.int32)
        for level in range(self.levels):
            shift = self.levels - 1 - level
            self.impact[level] = held
            bits = np.zeros(n_words * 8, dtype=np.uint8)
            packed = np.packbits(((seq >> shift) & 1).astype(bool), bitorder="little")
            bits[: len(packed)] = packed
            self.words[level] = bits.view("<u8")
            np.cumsum(np.bitwise_count(self.words[level][:-1]), out=self.before[level][1:])
            prefix = seq >> shift
            move = np.argsort(prefix.astype(np.uint16) if self.levels <= 16 else prefix, kind="stable")
            seq, held = seq[move], held[move]
        self.impact[self.levels] = held

    def rank(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place of a level."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple]) -> None:
        """Puts the documents that belong to the k best into the heap best of (score, -place, doc_id).

        place orders equal scores: doc_id, or NULL_PLACE.
        """
        l, r = self.start[terms], self.start[terms + 1]
        some = (l < r) & (weights > 0)
        if not some.any():
            return
        l, r, w = l[some], r[some], weights[some]
        # a node: level, prefix, begin and end among the level's places, and its slice of l, r, w; a chunk holds nodes of one expansion
        root = (w * self.impact[0, l]).sum()
        chunks = {0: (np.array([0]), np.array([0]), np.array([0]), np.array([self.impact.shape[1]]), np.array([0, len(l)]), l, r, w)}
        bound, least, chunk, row = np.array([root]), self.ids[:1], np.array([0]), np.array([0])
        alive, serial = {0: 1}, itertools.count(1)
        while len(bound):
            if len(best) >= k:
                stay = (bound > best[0][0]) | ((bound == best[0][0]) & (least < -best[0][1]))
                for c, gone in Counter(chunk[~stay].tolist()).items():
                    alive[c] -= gone
                bound, least, chunk, row = bound[stay], least[stay], chunk[stay], row[stay]
                if not len(bound):
                    break
            if len(bound) > STEP:
                order = np.argpartition(-bound, STEP)
                take, rest = order[:STEP], order[STEP:]
            else:
                take, rest = np.arange(len(bound)), np.arange(0)
            parts = []
            for c in np.unique(chunk[take]).tolist():
                mine = row[take][chunk[take] == c]
                parts.append(self._rows(chunks[c], mine))
                alive[c] -= len(mine)
            for c in [c for c, n in alive.items() if not n]:
                del alive[c], chunks[c]
            bound, least, chunk, row = bound[rest], least[rest], chunk[rest], row[rest]
            made = self._expand(parts)
            if made is None:
                continue
            nodes, score = made
            leaf = nodes[0] == self.levels
            if leaf.any():
                self._offer(nodes[1][leaf], score[leaf], k, best)
            inner = np.flatnonzero(~leaf)
            if len(inner):
                c = next(serial)
                chunks[c], alive[c] = nodes, len(inner)
                first = self.ids[nodes[1][inner] << (self.levels - nodes[0][inner])]
                bound, least = np.concatenate([bound, score[inner]]), np.concatenate([least, first])
                chunk, row = np.concatenate([chunk, np.full(len(inner), c)]), np.concatenate([row, inner])

    @staticmethod
    def _rows(chunk: tuple, rows: np.ndarray) -> tuple:
        """Some nodes of a chunk, as a chunk."""
        level, prefix, begin, end, ends, l, r, w = chunk
        size = ends[rows + 1] - ends[rows]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(upto[-1]) + np.repeat(ends[rows] - upto[:-1], size)
        return level[rows], prefix[rows], begin[rows], end[rows], upto, l[at], r[at], w[at]

    def _expand(self, parts: list[tuple]) -> tuple | None:
        """The children that hold a posting, as one chunk, with their bounds."""
        level, prefix, begin, end, l, r, w = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 5, 6, 7))
        node = np.repeat(np.arange(len(level)), np.concatenate([np.diff(p[4]) for p in parts]))
        before = self.rank(level, begin)
        ones = self.rank(level, end) - before
        at = level[node]
        set_l, set_r = self.rank(at, l) - before[node], self.rank(at, r) - before[node]
        zeros_end = end - ones  # where the right child begins
        children = []
        for bit, (cl, cr, cb, ce) in enumerate(((l - set_l, r - set_r, begin, zeros_end), (zeros_end[node] + set_l, zeros_end[node] + set_r, zeros_end, end))):
            full = cl < cr
            children.append((cl[full], cr[full], w[full], node[full] * 2 + bit, cb, ce))
        of = np.concatenate([c[3] for c in children])
        if not len(of):
            return None
        order = np.argsort(of, kind="stable")
        of = of[order]
        cl, cr, cw = (np.concatenate([c[i] for c in children])[order] for i in range(3))
        which, first = np.unique(of, return_index=True)
        parent, bit = which >> 1, which & 1
        deeper = level[parent] + 1
        gain = cw * self.impact[np.repeat(deeper, np.diff(np.append(first, len(of)))), cl]
        score = np.add.reduceat(gain, first)
        cb, ce = np.where(bit == 0, children[0][4][parent], children[1][4][parent]), np.where(bit == 0, children[0][5][parent], children[1][5][parent])
        return (deeper, prefix[parent] * 2 + bit, cb, ce, np.append(first, len(of)), cl, cr, cw), score

    def _offer(self, docs: np.ndarray, score: np.ndarray, k: int, best: list[tuple]) -> None:
        place = self.ids[docs]
        good = score > 0
        if len(best) >= k:
            good &= (score > best[0][0]) | ((score == best[0][0]) & (place < -best[0][1]))
        docs, place, score = docs[good], place[good], score[good]
        few = np.lexsort((place, -score))[:k]
        for s, p in zip(score[few].tolist(), place[few].tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, (s, -p))
            else:
                heapq.heappushpop(best, (s, -p))


#: Stands for a null doc_id among places.
NULL_PLACE = np.iinfo(np.int64).max
COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """COUNTED for each row of docs: how many terms it has in all, and how often it holds each of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                n, ends, terms, tfs = [], [0], [], []
                for text in part.column("text").cast(pa.large_binary()):
                    found = terms_of(text.as_py())
                    n.append(len(found))
                    for word, tf in Counter(found).items():
                        if (t := vocabulary.get(word)) is not None:
                            terms.append(t)
                            tfs.append(tf)
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


class Shard:
    """Documents as they come, until there are enough for a tree."""

    def __init__(self):
        self.ids, self.n, self.size, self.terms, self.tfs, self.postings = [], [], [], [], [], 0

    def add(self, ids: np.ndarray, n: np.ndarray, size: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        for held, new in ((self.ids, ids), (self.n, n), (self.size, size), (self.terms, terms), (self.tfs, tfs)):
            held.append(new)
        self.postings += len(terms)

    def tree(self, n_terms: int, n_docs: int, all_terms: int) -> DualSorted:
        ids, n, size, terms, tfs = (np.concatenate(x) for x in (self.ids, self.n, self.size, self.terms, self.tfs))
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), dtype=np.int64)
        number[order] = np.arange(len(ids))
        doc = np.repeat(number, size)
        return DualSorted(terms, doc, impacts(tfs.astype(np.int64), np.repeat(n, size), n_docs, all_terms), n_terms, ids[order])


def _pieces(part: pa.RecordBatch) -> tuple:
    ids = part.column("doc_id").fill_null(int(NULL_PLACE)).to_numpy(zero_copy_only=False)
    terms, tfs = part.column("terms"), part.column("tfs")
    size = np.diff(terms.offsets.to_numpy())
    return ids, part.column("n").to_numpy(), size, terms.flatten().to_numpy(), tfs.flatten().to_numpy()


def best_of(found: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item_no, doc_id, score): of each task's documents the k best for each item, among which are the k best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        shard = Shard()

        def search() -> None:
            tree = shard.tree(len(weights), n_docs, all_terms)
            for terms, heap in zip(items, best, strict=True):
                tree.search(terms, weights[terms], k, heap)

        held = 0
        for batch in batches:
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                pieces = _pieces(part)
                if held and (held + len(pieces[0]) > SHARD_DOCS or shard.postings + len(pieces[3]) > MAX_POSTINGS):
                    search()
                    shard, held = Shard(), 0
                shard.add(*pieces)
                held += len(pieces[0])
        if held:
            search()
        for no, heap in enumerate(best):
            if heap:
                score, place = zip(*heap, strict=True)
                ids = -np.array(place, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(heap), pa.int64()), pa.array(ids, pa.int64(), mask=ids == NULL_PLACE), pa.array(score, pa.int64())], names=["item_no", "doc_id", "score"])

    return found.where("n > 0 and size(terms) > 0").mapInArrow(run, "item_no long, doc_id long, score long")


def blocks(items: DataFrame) -> Iterator[list[tuple[Row, list[bytes]]]]:
    """The items with their distinct terms, in blocks of at most BLOCK_TERMS distinct terms."""
    block, seen = [], set()
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        terms = sorted(set(terms_of((row.text or "").encode("utf-8", "surrogatepass"))))
        if block and len(seen.union(terms)) > BLOCK_TERMS:
            yield block
            block, seen = [], set()
        seen.update(terms)
        block.append((row, terms))
    yield block


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs(doc_id, text) for each of items(item_id, text)."""
    parts = [_searched(docs, items, block, k) for block in blocks(items)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _searched(docs: DataFrame, items: DataFrame, block: list[tuple[Row, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    found = Stored(counted(docs, vocabulary), "ranked-search").df
    n_docs, all_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[term] = weight(n_docs, df)
    wanted = [np.array([vocabulary[t] for t in terms], dtype=np.int64) for _, terms in block]
    best = best_of(found, wanted, weights, n_docs, max(1, all_terms), k)
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    names = spark.createDataFrame([(no, row.item_id) for no, (row, _) in enumerate(block)], f"item_no long, item_id {dict(items.dtypes)['item_id']}")
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")
