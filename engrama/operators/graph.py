"""The association graph: co-access tallies, closures, plasticity, spreading, neighbourhoods."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config
from engrama.operators.ordered import value_at
from engrama.operators.shared import cut

DAY = 86_400.0


def omega(total_edges: int, episodes: int, cfg: Config = DEFAULT) -> float:
    """How much co-access counts in a rank: ramps up with edges per episode."""
    return 0.0 if episodes <= 0 else cfg.sr_omega_max * min(1.0, total_edges / max(1.0, episodes * cfg.sr_cold_start_ratio))


# co-access


def window_pairs(accesses: DataFrame, window: float, hub: int | None = None) -> DataFrame:
    """(prior, cur, seq): earlier accesses of other records at most `window` seconds before each access.

    An interval join by time buckets: each prior access is posted in its own bucket and the
    next, so each access meets the buckets that can hold its window, and no others. The
    accesses of a bucket with more than HUB are dealt out in parts, each of which meets all
    the prior ones, so a burst is not one task.
    """
    bucket = F.floor(F.col("t") / window)
    parts = accesses.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / (hub or HUB)).cast("int").alias("parts")).where("parts > 1")
    one = F.coalesce("parts", F.lit(1))
    cur = accesses.select(F.col("seq").alias("seq"), F.col("ep_id").alias("cur"), F.col("t").alias("t"), bucket.alias("bucket")).join(parts, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("seq"), one).cast("int")).drop("parts")
    prior = accesses.select(F.col("seq").alias("seq0"), F.col("ep_id").alias("prior"), F.col("t").alias("t0"), F.explode(F.array(bucket, bucket + 1)).alias("bucket")).join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    close = (F.col("seq0") < F.col("seq")) & (F.col("t0") >= F.col("t") - window) & (F.col("t0") <= F.col("t")) & (F.col("prior") != F.col("cur"))
    return cur.join(prior, ["bucket", "part"]).where(close).select("prior", "cur", "seq")


def _pairs_most(accesses: DataFrame, window: float) -> tuple[int, int]:
    """A bound on the pairs of accesses within a window, from the counts of its buckets; and about how many records there are."""
    n = accesses.groupBy(F.floor(F.col("t") / window).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = n.select((F.col("b") + 1).alias("b"), F.col("n").alias("n0"))
    pairs = n.join(before, "b", "left").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.coalesce("n0", F.lit(0)))).first()[0]
    return int(pairs or 0), accesses.agg(F.approx_count_distinct("ep_id")).first()[0] if pairs else 0


def _access_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's accesses in time order as packs of kind 0; further pairs (ep_id, seq, hits, to) of kind 1; one of kind 2 that marks the block."""
    nth, held, n = 0, [], 0

    def pack(kind: int, block: int, rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal nth
        nth += 1
        t = rows["t"].to_numpy(np.float64)
        ends = [t.min()] if kind == 0 else [0.0], [t.max()] if kind == 0 else [0.0]
        flat = {c: [rows[c].to_numpy(d).tobytes()] for c, d in (("seq", "i8"), ("ep_id", "i8"), ("t", "f8"), ("hits", "i8"), ("to", "i4")) if kind != 2 and (kind == 1 or c not in ("hits", "to"))}
        return pd.DataFrame({"block": [block], "nth": [nth], "kind": [kind], "lo": ends[0], "hi": ends[1]} | {c: flat.get(c, [b""]) for c in ("seq", "ep_id", "t", "hits", "to")})

    for pdf in batches:
        for kind, rows in pdf.groupby("kind"):
            if kind:
                yield pack(int(kind), int(rows["block"].iloc[0]), rows.fillna(0))
                continue
            held.append(rows)
            n += len(rows)
            if n >= TALLY_PACK:
                yield pack(0, int(rows["block"].iloc[0]), pd.concat(held))
                held, n = [], 0
    if n:
        yield pack(0, int(held[0]["block"].iloc[0]), pd.concat(held))


class _Cell:
    """Counts of pairs (src, dst) as codes of both ends."""

    def __init__(self):
        self.codes: dict[int, int] = {}
        self.known: dict[tuple[int, int], np.ndarray] = {}
        self.keys, self.hits, self.new, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def code(self, ids: np.ndarray, pack: tuple[int, int]) -> np.ndarray:
        if pack not in self.known:
            distinct, at = np.unique(ids, return_inverse=True)
            self.known[pack] = np.array([self.codes.setdefault(i, len(self.codes)) for i in distinct.tolist()], dtype=np.int64)[at]
        return self.known[pack]

    def add(self, src: np.ndarray, dst: np.ndarray, hits: np.ndarray | None = None) -> None:
        keys = src << 32 | dst
        if hits is None:
            keys, hits = np.unique(keys, return_counts=True)
        self.new.append((keys, hits))
        self.n += len(keys)
        if self.n > max(1 << 22, len(self.keys) // 2):
            self.merge()

    def merge(self) -> None:
        keys, hits = (np.concatenate([first, *[x[at] for x in self.new]]) for at, first in enumerate((self.keys, self.hits)))
        self.new, self.n = [], 0
        order = np.argsort(keys, kind="stable")
        keys, hits = keys[order], hits[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.hits = keys[starts], np.add.reduceat(hits, starts) if len(keys) else hits

    def rows(self) -> Iterator[pd.DataFrame]:
        self.merge()
        ids = np.fromiter(self.codes, np.int64, len(self.codes))
        for at in range(0, len(self.keys), 1 << 18):
            k = self.keys[at : at + (1 << 18)]
            yield pd.DataFrame({"src": ids[k >> 32], "dst": ids[k & 0xFFFFFFFF], "hits": self.hits[at : at + (1 << 18)]})


def _cell_pairs(batches: Iterator[pd.DataFrame], window: float) -> Iterator[pd.DataFrame]:
    """Counts of a cell's pairs: each access of a later pack with the earlier accesses of a pack of priors that are in its window."""
    cell = _Cell()
    of = lambda r, side: [np.frombuffer(getattr(r, side + c), d) for c, d in (("seq", "i8"), ("ep_id", "i8"), ("t", "f8"))]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            seq0, ep0, t0 = of(r, "p_")
            here = cell.code(ep0, (r.p_block, r.p_nth))
            if r.p_kind == 1:
                mine = np.frombuffer(r.p_to, "i4") == r.c_block
                if mine.any():
                    cell.add(here[mine], cell.code(seq0, (-1 - r.p_block, r.p_nth))[mine], np.frombuffer(r.p_hits, "i8")[mine])
                continue
            seq, ep, t = of(r, "c_")
            there = cell.code(ep, (r.c_block, r.c_nth))
            lo, hi = np.searchsorted(t0, t - window, "left"), np.searchsorted(t0, t, "right")
            total = np.concatenate([[0], np.cumsum(hi - lo)])
            at = 0
            while at < len(t):
                end = max(at + 1, int(np.searchsorted(total, total[at] + TALLY_SLICE, "right")) - 1)
                cur = np.repeat(np.arange(at, end), hi[at:end] - lo[at:end])
                prior = np.arange(total[at], total[end]) - np.repeat(total[at:end] - lo[at:end], hi[at:end] - lo[at:end])
                ok = (seq0[prior] < seq[cur]) & (here[prior] != there[cur])
                cell.add(here[prior[ok]], there[cur[ok]])
                at = end
    yield from cell.rows()


def _tally_in_grid(accesses: DataFrame, window: float, side: int, further: DataFrame | None) -> DataFrame:
    """(src, dst, hits) by a grid of `side` blocks of records as priors and as what follows them.

    The accesses are written once, by blocks in time order, in packs; a cell reads two blocks and meets the packs
    whose times are within the window. So no pair is shuffled, and a pair's count is whole in its cell.
    further(src, dst, hits): pairs to count besides.
    """
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(side)).cast("int")
    spark = accesses.sparkSession
    some = accesses.where("seq is not null and ep_id is not null and t is not null").select(block("ep_id").alias("block"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("ep_id").cast("long").alias("ep_id"), F.col("t").cast("double").alias("t"), F.lit(None).cast("long").alias("hits"), F.lit(None).cast("int").alias("to"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    some = some.unionByName(spark.range(side).select(F.col("id").cast("int").alias("block"), F.lit(2).alias("kind"), null("long", "seq"), null("long", "ep_id"), null("double", "t"), null("long", "hits"), null("int", "to")))
    if further is not None:
        some = some.unionByName(further.select(block("src").alias("block"), F.lit(1).alias("kind"), F.col("dst").cast("long").alias("seq"), F.col("src").cast("long").alias("ep_id"), null("double", "t"), "hits", block("dst").alias("to")))
    ordered = some.repartitionById(side, F.col("block")).sortWithinPartitions("kind", "t", "seq")
    packs = cut(ordered.mapInPandas(_access_packs, "block int, nth int, kind int, lo double, hi double, seq binary, ep_id binary, t binary, hits binary, to binary"))
    p, c = packs.where("kind < 2"), packs.where("kind <> 1").drop("hits", "to")
    p, c = p.withColumnsRenamed({x: f"p_{x}" for x in p.columns}), c.withColumnsRenamed({x: f"c_{x}" for x in c.columns})
    near = (F.col("p_kind") == 0) & (F.col("c_kind") == 0) & (F.col("p_hi") >= F.col("c_lo") - window) & (F.col("p_lo") <= F.col("c_hi"))
    met = p.hint("shuffle_replicate_nl").join(c, near | ((F.col("p_kind") == 1) & (F.col("c_kind") == 2)))
    return met.mapInPandas(lambda batches: _cell_pairs(batches, window), "src long, dst long, hits long")


def _tally(accesses: DataFrame, window: float, further: DataFrame | None = None) -> DataFrame:
    """Counts of window pairs, and of further(src, dst, hits). Pairs are shuffled to be counted up to TALLY_PAIRS of them; more are counted in a grid."""
    pairs, records = _pairs_most(accesses, window)
    if pairs > TALLY_PAIRS:
        cells = max(min(pairs, records**2) / CELL_PAIRS, pairs / CELL_WORK, 2 * accesses.sparkSession.sparkContext.defaultParallelism)
        return _tally_in_grid(accesses, window, ceil(cells**0.5), further)
    found = window_pairs(accesses, window).select(F.col("prior").alias("src"), F.col("cur").alias("dst"), F.lit(1).cast("long").alias("hits"))
    found = found if further is None else found.unionByName(further)
    return found.groupBy("src", "dst").agg(F.sum("hits").alias("hits"))


def tally(accesses: DataFrame, window: float = DEFAULT.sr_window_seconds) -> DataFrame:
    """(src, dst, hits): how often dst was accessed within the window after src."""
    return _tally(accesses, window)


def recall_tally(sets: DataFrame, window: float = DEFAULT.sr_window_seconds) -> DataFrame:
    """(src, dst, hits) of recall sets (seq, anchor, others, t): earlier anchors to the anchor, and the anchor to the others."""
    out = sets.select(F.col("anchor").alias("src"), F.explode("others").alias("dst")).where("src <> dst")
    return _tally(sets.select("seq", F.col("anchor").alias("ep_id"), "t"), window, out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("hits")))


def tally_without(accesses: DataFrame, gone: DataFrame, window: float = DEFAULT.sr_window_seconds) -> DataFrame:
    """evict(tally(accesses), gone), with the accesses of gone(id) left out first: a pair's count does not depend on other records."""
    return tally(accesses.join(gone.select(F.col("id").alias("ep_id")), "ep_id", "left_anti"), window)


def evict(tallies: DataFrame, gone: DataFrame) -> DataFrame:
    """Tallies without the records in gone(id), at either end."""
    return tallies.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")


#: Events of a chunk that one task folds.
TD_CHUNK = 1 << 14
#: Graphs of so many nodes, or of so many events a node, fold by columns; others by composed chunks.
TD_NODES, TD_EVENTS = 1 << 14, 32
#: Cells of the closure that one task holds, least columns of a block, events in a pack, rows that are gathered at once.
TD_CELLS, TD_COLUMNS, TD_PACK, TD_GATHER = 1 << 24, 32, 1 << 17, 256
#: Edges out of a node, or accesses of a time bucket, that one task joins at most, about.
HUB = 4096
#: Window pairs that are shuffled at most; distinct pairs and pairs of a cell of the grid, about; accesses of a pack, pairs that are spelt out at once.
TALLY_PAIRS, CELL_PAIRS, CELL_WORK, TALLY_PACK, TALLY_SLICE = 1 << 26, 1 << 23, 1 << 27, 1 << 16, 1 << 21
#: A chunk's effect on the closure: row i becomes the sum of v times old row k (kind 'row') and of v at column k (kind 'col').
EFFECT = "chunk long, i long, kind string, k long, v double"


def _fold(batches: Iterator[pd.DataFrame], alpha: float, gamma: float) -> Iterator[pd.DataFrame]:
    """The effect of a chunk's ordered events: the update rule, run on rows that are not known yet."""
    rows: dict[int, dict[tuple[str, int], float]] = {}
    chunk = TaskContext.get().partitionId()
    for pdf in batches:
        for i, j in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            row = rows.setdefault(i, {("row", i): 1.0})
            ahead = dict(rows[j]) if j in rows else {("row", j): 1.0}
            for k in row:
                row[k] *= 1 - alpha
            for k, v in ahead.items():
                row[k] = row.get(k, 0.0) + alpha * gamma * v
            row["col", j] = row.get(("col", j), 0.0) + alpha
    if rows:
        flat = [(chunk, i, kind, k, v) for i, row in rows.items() for (kind, k), v in row.items()]
        yield pd.DataFrame(flat, columns=["chunk", "i", "kind", "k", "v"])


def _joined_effects(effects: DataFrame) -> DataFrame:
    """Effects of neighbouring chunks 2c, 2c + 1 as one of chunk c: the later one's rows stand for what the earlier one made of them."""
    half = F.floor(F.col("chunk") / 2).alias("chunk")
    early = effects.where("chunk % 2 = 0").select(half, "i", "kind", "k", "v")
    late = effects.where("chunk % 2 = 1").select(half, "i", "kind", "k", "v")
    made = early.select("chunk", F.col("i").alias("k"), F.col("kind").alias("_kind"), F.col("k").alias("_k"), F.col("v").alias("_v"))
    through = late.where("kind = 'row'").join(made, ["chunk", "k"], "left")  # a row that the earlier chunk did not write stays itself
    through = through.select("chunk", "i", F.coalesce("_kind", "kind").alias("kind"), F.coalesce("_k", "k").alias("k"), (F.col("v") * F.coalesce("_v", F.lit(1.0))).alias("v"))
    summed = through.unionByName(late.where("kind = 'col'")).groupBy("chunk", "i", "kind", "k").agg(F.sum("v").alias("v"))
    left = early.join(late.select("chunk", "i").distinct(), ["chunk", "i"], "left_anti")
    out = summed.unionByName(left.select(summed.columns))
    return out.where("chunk > 0 or kind = 'col'")  # before the first chunk all rows are empty


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's ordered events as rows of up to TD_PACK events or a batch more: distinct ids, and codes of both ends."""
    chunk, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

    def pack() -> pd.DataFrame:
        both = np.concatenate([h[0] for h in held] + [h[1] for h in held])
        ids, codes = np.unique(both, return_inverse=True)
        codes = codes.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        return pd.DataFrame({"chunk": [chunk], "nth": [nth], "n": [len(both) // 2], "ids": [zlib.compress(np.diff(ids, prepend=0).tobytes(), 1)], "codes": [zlib.compress(codes.tobytes(), 1)]})

    for pdf in batches:
        held.append((pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)))
        n += len(pdf)
        if n >= TD_PACK:
            yield pack()
            nth, held, n = nth + 1, [], 0
    if n:
        yield pack()


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(blocks)


def _ends(starts: np.ndarray) -> list[int]:
    """For each place the end of its run, by marks where runs start."""
    at = np.append(np.flatnonzero(starts), len(starts))
    return np.repeat(at[1:], np.diff(at)).tolist() if len(starts) else []


class _Columns:
    """All rows of the closure in one block's columns, and which cells have been written."""

    def __init__(self, alpha: float, gamma: float, block: int, blocks: int, nodes: int):
        self.a, self.gamma, self.gain, self.keep, self.block, self.blocks = alpha, gamma, alpha * gamma, 1 - alpha, block, blocks
        self.rows: dict[int, int] = {}
        self.cols: dict[int, int] = {}
        self.seen: list[int] = []  # for each row the columns that have been written, as bits
        self._room(nodes, ceil(nodes / blocks * 1.2) + 8)

    def _room(self, rows: int, cols: int) -> None:
        """Cells for so many rows and columns at least."""
        m = np.zeros((rows, cols))
        if self.rows:
            m[: self.m.shape[0], : self.m.shape[1]] = self.m
        self.m = m

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each id; column -1 outside the block."""
        mine = _block_of(ids, self.blocks) == self.block
        old = len(self.rows)
        rows = np.array([self.rows.setdefault(i, len(self.rows)) for i in ids.tolist()])
        cols = np.full(len(ids), -1)
        cols[mine] = [self.cols.setdefault(i, len(self.cols)) for i in ids[mine].tolist()]
        grown = lambda n, have: n if n <= have else max(n, have + have // 2)
        if len(self.rows) > self.m.shape[0] or len(self.cols) > self.m.shape[1]:
            self.rows, whole = dict(list(self.rows.items())[:old]), self.rows
            self._room(max(self.m.shape[0], grown(len(whole), self.m.shape[0])), max(self.m.shape[1], grown(len(self.cols), self.m.shape[1])))
            self.rows = whole
        self.seen += [0] * (len(self.rows) - len(self.seen))
        return rows, cols

    def fold(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        """Ordered events, as codes of ids. Runs that end at one node, and runs that begin at one, are each one step.

        The rows that a run reads are not among those that it writes, so its events may go together:
        a run into j moves distinct rows towards row j, a run out of i adds up what its ends have.
        """
        if not len(src):
            return
        rows, cols = self._places(ids)
        own = src == dst
        cut_off = own.copy()
        cut_off[1:] |= own[:-1]
        cut_off[0] = True
        into, out = cut_off.copy(), cut_off.copy()
        into[1:] |= dst[1:] != dst[:-1]
        out[1:] |= src[1:] != src[:-1]
        run = np.cumsum(into)
        by = np.lexsort((src, run))
        again = (run[by][1:] == run[by][:-1]) & (src[by][1:] == src[by][:-1])
        into[by[1:][again]] = True
        into_end, out_end = _ends(into), _ends(out)
        src, col, dst = rows[src], cols[dst].astype(np.int64), rows[dst]
        srcs, dsts, columns = src.tolist(), dst.tolist(), col.tolist()
        m, seen, a, gain, keep = list(self.m), self.seen, self.a, self.gain, self.keep
        multiply, add = np.multiply, np.add
        at, n = 0, len(srcs)
        while at < n:
            i, j, c = srcs[at], dsts[at], columns[at]
            if i == j:
                m[i] *= keep + gain
                if c >= 0:
                    m[i][c] += a
                    seen[i] |= 1 << c
                at += 1
            elif into_end[at] >= out_end[at]:
                end = into_end[at]
                gained, bits = m[j] * gain, seen[j]
                if c >= 0:
                    gained[c] += a
                    bits |= 1 << c
                if end - at < 3:
                    for i in srcs[at:end]:
                        row = m[i]
                        multiply(row, keep, row)
                        add(row, gained, row)
                else:
                    moved = self.m.take(src[at:end], axis=0)
                    multiply(moved, keep, moved)
                    add(moved, gained, moved)
                    self.m[src[at:end]] = moved
                for i in srcs[at:end]:
                    seen[i] |= bits
                at = end
            else:
                end = min(out_end[at], at + TD_GATHER)
                w = a * keep ** np.arange(end - at - 1, -1, -1)
                row, bits = m[i], seen[i]
                row *= keep ** (end - at)
                row += (self.gamma * w) @ self.m.take(dst[at:end], axis=0)
                for j, c, x in zip(dsts[at:end], columns[at:end], w.tolist(), strict=True):
                    bits |= seen[j]
                    if c >= 0:
                        row[c] += x
                        bits |= 1 << c
                seen[i] = bits
                at = end

    def written(self) -> Iterator[pd.DataFrame]:
        """(src, dst, m) of all cells that events have written."""
        src, dst = np.fromiter(self.rows, np.int64, len(self.rows)), np.fromiter(self.cols, np.int64, len(self.cols))
        width = ceil(len(dst) / 8)
        step = max(1, (1 << 18) // max(1, len(dst)))
        for at in range(0, len(src) if len(dst) else 0, step):
            bits = np.frombuffer(b"".join(x.to_bytes(width, "little") for x in self.seen[at : at + step]), np.uint8).reshape(-1, width)
            r, c = np.nonzero(np.unpackbits(bits, axis=1, count=len(dst), bitorder="little"))
            yield pd.DataFrame({"src": src[r + at], "dst": dst[c], "m": self.m[r + at, c]})


def _by_columns(events: DataFrame, blocks: int, nodes: int, alpha: float, gamma: float, sweeps: int) -> DataFrame:
    """The fold of events(src, dst), ordered through their partitions, each block of columns by itself."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            for block, n, ids, codes in zip(pdf["block"], pdf["n"], pdf["ids"], pdf["codes"], strict=True):
                if state is None or state.block != block:
                    if state is not None:
                        yield from state.written()
                    state = _Columns(alpha, gamma, block, blocks, nodes)
                ids, codes = np.frombuffer(zlib.decompress(ids), np.int64).cumsum(), zlib.decompress(codes)
                codes = np.frombuffer(codes, np.uint16 if len(codes) == 4 * n else np.uint32)
                state.fold(ids, codes[:n], codes[n:])
        if state is not None:
            yield from state.written()

    packed = events.mapInPandas(_packed, "chunk long, nth long, n long, ids binary, codes binary")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))).alias("sweep")
    dealt = packed.select("*", rounds).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "sweep", "chunk", "nth").mapInPandas(fold, "src long, dst long, m double")


def td_closure(pairs: DataFrame, order: list[str], alpha: float = DEFAULT.sr_alpha, gamma: float = DEFAULT.sr_gamma, sweeps: int = 1, chunk: int | None = None) -> DataFrame:
    """(src, dst, m): the discounted closure learned edge by edge, in the given order.

    Each step reads what earlier steps wrote, yet every step is linear in the rows: so the
    effect of any run of events is a sparse linear map, which does not depend on the state
    that it meets. The events are cut into chunks of their order; each task folds a chunk's
    map, and neighbouring maps are composed by joins, half as many after each round, until
    one is left, applied to no rows at all. That is the fold in its order, up to rounding:
    chunks fold side by side, chains of any length cost no rounds, no task holds the graph.

    Where the closure is dense, these maps grow full and their composition costs the cube of
    the nodes. But a step treats each column by itself, so there (without a `chunk` that is
    asked for) blocks of columns fold side by side: each task holds all rows of its columns,
    at most about TD_CELLS cells, and streams the packed events past them.
    """
    n, nodes = pairs.agg(F.count(F.lit(1)), F.approx_count_distinct("src") + F.approx_count_distinct("dst")).first()
    if not n or sweeps < 1:
        return pairs.sparkSession.createDataFrame([], "src long, dst long, m double")
    nodes = ceil(nodes * 0.55)  # about half of both counts together, if most nodes are at both ends; tables grow if not
    dense = chunk is None and (nodes <= TD_NODES or n >= TD_EVENTS * nodes)
    chunks = ceil(n / (chunk or (4 * TD_PACK if dense else TD_CHUNK)))
    dealt = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *[F.col(c).alias(f"_at{x}") for x, c in enumerate(order)])
    at = [F.col(f"_at{x}") for x in range(len(order))]
    ranged = dealt.repartitionByRange(chunks, *at).sortWithinPartitions(*at) if chunks > 1 else dealt.coalesce(1).sortWithinPartitions(*at)
    if dense:
        most = max(1, nodes // TD_COLUMNS)
        blocks = max(ceil(nodes / max(1, TD_CELLS // nodes)), min(most, pairs.sparkSession.sparkContext.defaultParallelism))
        return _by_columns(ranged.select("src", "dst"), blocks, nodes, alpha, gamma, sweeps)
    effects = cut(ranged.select("src", "dst").mapInPandas(lambda batches: _fold(batches, alpha, gamma), EFFECT))
    count = chunks * sweeps
    if sweeps > 1:
        effects = effects.withColumn("chunk", F.explode(F.sequence(F.col("chunk"), F.col("chunk") + (sweeps - 1) * chunks, F.lit(chunks).cast("long"))))
    effects = effects.where("chunk > 0 or kind = 'col'")
    while count > 1:
        effects, count = cut(_joined_effects(effects)), ceil(count / 2)
    return effects.where("kind = 'col'").select(F.col("i").alias("src"), F.col("k").alias("dst"), F.col("v").alias("m"))


def _steps(t: DataFrame, frontier: DataFrame, hub: int) -> DataFrame:
    """frontier(start, node, p) one step along t(src, dst, p), summed by (start, node); a hub's edges are dealt out in parts."""
    parts = t.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts"))
    cut_t = t.join(parts, "src").select(F.col("src").alias("node"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), F.col("dst").alias("to"), F.col("p").alias("q"))
    sent = frontier.join(parts.withColumnRenamed("src", "node"), "node").select("start", "node", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return sent.join(cut_t, ["node", "part"]).groupBy("start", F.col("to").alias("node")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def power_series(edges: DataFrame, gamma: float = DEFAULT.sr_gamma, depth: int = 3, anchors: DataFrame | None = None, hub: int | None = None) -> DataFrame:
    """(src, dst, m): the sum over k up to depth of gamma^(k-1) T^k, for T with rows that sum to 1.

    anchors(id): the only src that are wanted. Then it starts at them, and each step reads
    and normalises the edges out of the nodes that it has come to, no others.
    """
    t = edges.groupBy("src", "dst").agg(F.sum("hits").alias("h"))

    def normal(t: DataFrame) -> DataFrame:
        return t.join(t.groupBy("src").agg(F.sum("h").alias("s")), "src").select("src", "dst", (F.col("h") / F.col("s")).alias("p"))

    if anchors is None:
        whole = normal(t)
        of = lambda nodes: whole
        frontier = whole.select(F.col("src").alias("start"), F.col("dst").alias("node"), "p")
    else:
        of = lambda nodes: normal(edges.join(nodes, "src", "left_semi").groupBy("src", "dst").agg(F.sum("hits").alias("h")))
        first = of(anchors.select(F.col("id").alias("src")).distinct())
        frontier = first.select(F.col("src").alias("start"), F.col("dst").alias("node"), "p")
    out = frontier.withColumnRenamed("p", "m")
    for k in range(1, depth):
        if k > 1:
            frontier = cut(frontier)  # read by the next step in three places
        frontier = _steps(of(frontier.select(F.col("node").alias("src")).distinct()), frontier, hub or HUB)
        out = out.union(frontier.select("start", "node", (F.col("p") * gamma**k).alias("m")))
    return out.groupBy(F.col("start").alias("src"), F.col("node").alias("dst")).agg(F.sum("m").alias("m"))


# plasticity


def _touch(acc: Column, e: Column, cfg: Config) -> Column:
    """One reinforcement of an edge: acc has weight, bonus, hits, in_window, set_at; e has t and score."""
    first = acc["set_at"].isNull()
    elapsed = F.greatest(F.lit(0.0), e["t"] - acc["set_at"])
    kept = F.when(first, acc["bonus"]).otherwise(acc["bonus"] * F.exp(-elapsed / cfg.e_ltp_seconds))
    n = F.when(~first & (elapsed <= cfg.e_ltp_seconds), acc["in_window"] + 1).otherwise(1)
    finite = e["score"].isNotNull() & ~F.isnan(e["score"]) & (F.abs(e["score"]) != float("inf"))
    gain = F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["score"]))).otherwise(0.0)
    raised = kept + 0.5 * gain * F.when(acc["hits"] >= cfg.habit_hits, cfg.habit_savings).otherwise(1.0)
    folds = n >= cfg.l_ltp_hits
    return F.struct(
        F.when(folds, acc["weight"] + raised).otherwise(acc["weight"]).alias("weight"), F.when(folds, 0.0).otherwise(raised).alias("bonus"), (acc["hits"] + 1).alias("hits"),
        F.when(folds, 0).otherwise(n).cast("int").alias("in_window"), e["t"].alias("set_at"),
    )


def plasticity_fold(reinforcements: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(src_id, dst_id, weight, bonus, hits, hits_in_window, bonus_set_at): each edge's events folded in time order, in the JVM."""
    per = reinforcements.where("src_id <> dst_id").groupBy("src_id", "dst_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "score"))).alias("events"))
    start = F.struct(F.lit(0.0).alias("weight"), F.lit(0.0).alias("bonus"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("in_window"), F.lit(None).cast("double").alias("set_at"))
    folded = per.select("src_id", "dst_id", F.aggregate("events", start, lambda acc, e: _touch(acc, e, cfg)).alias("s"))
    return folded.select("src_id", "dst_id", "s.weight", "s.bonus", "s.hits", F.col("s.in_window").alias("hits_in_window"), F.col("s.set_at").alias("bonus_set_at"))


def ltd(edges: DataFrame, now: float, cfg: Config = DEFAULT, budget: int | None = None) -> DataFrame:
    """Plasticity edges after decay: adds `pruned`. With a budget the stalest edges come first and the rest stay.

    Decay leaves both clocks as they were, so a further pass decays from the same origin
    again, unless cfg.ltd_advance_clock.
    """
    out = edges.where("kind = 'plasticity'")
    if budget is not None:
        out = out.orderBy("last_touch", "src_id", "dst_id").limit(budget)
    habit = F.col("hits") >= cfg.habit_hits
    idle = F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("last_touch")) * cfg.time_compression / DAY
    rate = F.when(habit, 1 - cfg.ltd_per_day * cfg.habit_multiplier).otherwise(1 - cfg.ltd_per_day)
    weight = F.col("weight") * F.pow(rate, idle)
    bonus = F.col("bonus") * F.exp(-F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("last_touch")) / cfg.e_ltp_seconds)
    out = out.withColumns({"weight": weight, "bonus": bonus, "pruned": (weight + bonus < cfg.prune_floor) & ~habit})
    return out.withColumn("last_touch", F.lit(float(now))) if cfg.ltd_advance_clock else out


def strength(edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """edge_weight = weight + bonus and is_habit of plasticity edges."""
    return edges.where("kind = 'plasticity'").withColumns({"edge_weight": F.col("weight") + F.col("bonus"), "is_habit": F.col("hits") >= cfg.habit_hits})


# spreading and neighbourhoods


def spreading(edges: DataFrame, anchors: DataFrame, hops: int = DEFAULT.spread_hops, cfg: Config = DEFAULT) -> DataFrame:
    """(anchor, id, activation): the best product of decay x durable weight along up to `hops` edges; the anchor has 1."""
    usable = edges.where("kind = 'plasticity' and weight > 0").select("src_id", "dst_id", "weight")
    nth = F.row_number().over(Window.partitionBy("src_id").orderBy(F.col("weight").desc(), "dst_id"))
    fan = usable.withColumn("_r", nth).where(F.col("_r") <= cfg.spread_fanout).drop("_r")
    best = frontier = anchors.select("anchor", F.col("anchor").alias("id"), F.lit(1.0).alias("activation"))
    for _ in range(hops):
        reached = frontier.join(fan, F.col("id") == F.col("src_id")).select("anchor", F.col("dst_id").alias("id"), (F.col("activation") * cfg.spread_decay * F.col("weight")).alias("activation"))
        reached = reached.groupBy("anchor", "id").agg(F.max("activation").alias("activation"))
        old = best.withColumnRenamed("activation", "_old")
        frontier = reached.join(old, ["anchor", "id"], "left").where(F.col("_old").isNull() | (F.col("activation") > F.col("_old"))).drop("_old")
        best = best.union(frontier).groupBy("anchor", "id").agg(F.max("activation").alias("activation"))
    return best


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour), both directions of all kinds, distinct."""
    return edges.selectExpr("src_id as id", "dst_id as neighbour").union(edges.selectExpr("dst_id as id", "src_id as neighbour")).distinct()


def focus(edges: DataFrame, start: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """(id, depth): breadth-first layers around start(id), undirected, up to max_nodes nodes.

    Within a layer nodes come in by (parent, neighbour), so the cap is deterministic.
    """
    around = adjacency(edges)
    seen = start.select("id", F.lit(0).alias("depth"))
    n = seen.count()
    for layer in range(1, depth + 1):
        room = max_nodes - n
        if room <= 0:
            break
        frontier = seen.where(F.col("depth") == layer - 1).select("id")
        new = around.join(frontier, "id").groupBy("neighbour").agg(F.min("id").alias("parent")).join(seen.select(F.col("id").alias("neighbour")), "neighbour", "left_anti")
        taken = new.orderBy("parent", "neighbour").limit(room).select(F.col("neighbour").alias("id"), F.lit(layer).alias("depth"))
        seen = seen.union(taken)
        n = seen.count() if layer < depth else n  # at most max_nodes rows
    return seen


def overlay(edges: DataFrame, nodes: DataFrame, kind: str = "plasticity") -> DataFrame:
    """Edges of a kind with both ends in nodes(id)."""
    e = edges.where(F.col("kind") == kind)
    return e.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")


def global_view(edges: DataFrame, max_nodes: int) -> DataFrame:
    """Co-access edges among the max_nodes smallest ids that have any: a cap that both ends keep to."""
    sr = edges.where("kind = 'sr'")
    nodes = sr.select(F.col("src_id").alias("id")).union(sr.select(F.col("dst_id").alias("id"))).distinct().orderBy("id").limit(max_nodes)
    return overlay(edges, nodes, "sr")


def bridge_scores(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, score): weights of a node's edges that cross communities(id, community)."""
    c = communities.select("id", "community")
    e = edges.join(c.select(F.col("id").alias("src_id"), F.col("community").alias("a")), "src_id").join(c.select(F.col("id").alias("dst_id"), F.col("community").alias("b")), "dst_id").where("a <> b")
    ends = e.select(F.explode(F.array("src_id", "dst_id")).alias("id"), F.col("edge_weight").alias("w"))
    return ends.groupBy("id").agg(F.sum("w").alias("score"))


def bridges(scores: DataFrame) -> DataFrame:
    """Nodes at or over the score at place floor(0.75 n) of the ascending non-zero scores."""
    s = scores.where("score > 0")
    n = s.count()
    return s.where(F.col("score") >= value_at(s, "score", int(0.75 * n), n)) if n else s


def drift_fold(touches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(ep_id, drift_total, drift_locked, last): reconsolidation of each record over its (t, seq, score), in time order."""
    per = touches.groupBy("ep_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "score"))).alias("events"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(False).alias("locked"), F.lit(0.0).alias("last"))

    def step(acc, e):
        skip = acc["locked"] | (e["score"] < cfg.drift_min_score)
        late = (acc["last"] > 0) & (e["t"] - acc["last"] > cfg.drift_window_seconds)
        total = F.when(skip | late, acc["total"]).otherwise(acc["total"] + cfg.drift_alpha * e["score"])
        return F.struct(total.alias("total"), (acc["locked"] | (~skip & ~late & (total >= cfg.drift_max))).alias("locked"), F.when(skip, acc["last"]).otherwise(e["t"]).alias("last"))

    folded = per.select("ep_id", F.aggregate("events", start, step).alias("s"))
    return folded.select("ep_id", F.col("s.total").alias("drift_total"), F.col("s.locked").alias("drift_locked"), F.col("s.last").alias("last"))




def hull_communities(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(community, n, centre) of nodes(community, x): the communities that have a hull, those of `least` nodes or more, with the mean x that orders them."""
    return nodes.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("centre")).where(F.col("n") >= least)
