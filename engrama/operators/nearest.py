"""Exact nearest neighbours, by two ways with the same rows.

`nearest` is for a stated query set. If it fits in one block of MAX_QUERIES, the block comes
to the driver and every task holds it: rows stream past in Arrow batches, in tiles of
QUERY_TILE queries and ROW_TILE rows, each one matrix product of which only what is nearer
than a query's k-th best so far is looked at. What leaves a task is k rows a query. A larger
set goes the other way.

`in_grid` is for query sets that grow with the data, as when a table is searched for each of
its own rows. Rows and queries are dealt into the cells of a grid, and no row passes through
the driver. A group (a value of `within`) that fits in a block shares a bucket with others; a
larger one is cut, on the rows' side and on the queries' side, and every block of its rows
meets every block of its queries in a cell of their own. With `earlier` the blocks are cut
along ranges of ids, and blocks of later rows are not sent to earlier queries at all. A cell
holds about ROW_BLOCK rows and QUERY_BLOCK queries at most, also of a hot group.

Defined cases: null, empty, zero and not finite vectors are no queries and no neighbours;
a row is compared with queries of its width only; ties go by id; a null group meets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many queries are held by every task; a larger set goes in a grid.
MAX_QUERIES = 20_000
#: What a cell of the grid holds of a group at most, about, and what small tables are dealt into buckets by.
ROW_BLOCK, QUERY_BLOCK, LEAST_ROWS = 16_384, 8_192, 1_024
#: Ranges of ids that a cut group is first cut by, if only earlier rows count.
RANGES = 16
MAX_TASKS = 50_000
QUERY_TILE, ROW_TILE = 512, 4096


def usable(vectors: list) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Per width: places of the usable vectors, and the vectors at unit length."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            places.setdefault(len(v), []).append(i)
    at, units = {}, {}
    for width, mine in places.items():
        x = np.array([np.asarray(vectors[i], dtype=np.float64) for i in mine])
        with np.errstate(over="ignore", invalid="ignore"):
            n = np.linalg.norm(x, axis=1)
        good = np.isfinite(n) & (n > 0)
        if good.any():
            at[width], units[width] = np.array(mine)[good], x[good] / n[good, None]
    return at, units


class Best:
    """The k nearest (distance, id) of each of n queries so far, in ascending order."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, first: int, d: np.ndarray, ids: np.ndarray) -> None:
        """d: distances of the queries from `first` on to the rows `ids`; infinite ones do not count."""
        mine = slice(first, first + len(d))
        q, at = np.nonzero((d <= self.d[mine, -1:]) & (d < np.inf))
        if not len(q):
            return
        if len(q) > 4 * self.k * len(d) and d.shape[1] > self.k:  # more than can stay: up to each query's own k-th first
            q, at = np.nonzero((d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]) & (d <= self.d[mine, -1:]) & (d < np.inf))
        touched, row = np.unique(q, return_inverse=True)
        old = first + touched
        rows = np.concatenate([row, np.repeat(np.arange(len(touched)), self.k)])
        ds = np.concatenate([d[q, at], self.d[old].ravel()])
        all_ids = np.concatenate([ids[at], self.ids[old].ravel()])
        order = np.lexsort((all_ids, ds, rows))
        rows, ds, all_ids = rows[order], ds[order], all_ids[order]
        start = np.searchsorted(rows, np.arange(len(touched)))
        pick = (start[:, None] + np.arange(self.k)[None, :]).ravel()  # each has k old entries at least
        self.d[old], self.ids[old] = ds[pick].reshape(-1, self.k), all_ids[pick].reshape(-1, self.k)


def nearest(df: DataFrame, queries: DataFrame, k: int, within: str | None = None, earlier: bool = False) -> DataFrame:
    """(query_id, id, distance, nth): the k nearest rows of df(id, embedding) of each of a stated set of queries(query_id, vector).

    within: a column of both sides that must be equal (null equals nothing); earlier: only
    rows with an id under query_id.
    """
    block = queries.select("query_id", "vector", *([within] if within else [])).limit(MAX_QUERIES + 1).collect()
    if len(block) > MAX_QUERIES:
        return in_grid(df, queries, k, within, earlier)
    return _first(_block(df, block, k, within, earlier), k)


def _first(parts: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return parts.withColumn("nth", nth).where(F.col("nth") <= k)


def in_grid(df: DataFrame, queries: DataFrame, k: int, within: str | None = None, earlier: bool = False) -> DataFrame:
    """What `nearest` gives, for queries of any number. A query_id may ask in several groups; its rows are then merged."""
    spark = df.sparkSession
    g = F.col(within).cast("string") if within else F.lit("")
    rows = df.select(F.col("id").cast("long").alias("id"), "embedding", g.alias("g")).where("g is not null and size(embedding) > 0")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector", g.alias("g")).where("g is not null and size(vector) > 0")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sizes = rows.select("g", one.alias("r"), none.alias("q")).unionByName(asked.select("g", none.alias("r"), one.alias("q"))).groupBy("g").agg(F.sum("r").alias("r"), F.sum("q").alias("q"))
    is_hot = (F.col("r") > 0) & (F.col("q") > 0) & ((F.col("r") > ROW_BLOCK) | (F.col("q") > QUERY_BLOCK))
    seen = sizes.agg(F.coalesce(F.sum("r"), none).alias("r"), F.collect_list(F.when(is_hot, F.struct("g", "r", "q"))).alias("hot")).first()  # one hot group for each block of the table at most
    buckets = max(1, ceil(seen.r / ROW_BLOCK), min(spark.sparkContext.defaultParallelism, ceil(seen.r / LEAST_ROWS)) if within else 1)
    rows = rows.select("*", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"), F.lit(0).alias("row_block"))
    asked = asked.select("*", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"), F.lit(0).alias("query_block"))
    sent, met, cells = rows.withColumn("query_block", F.lit(0)), asked.withColumn("row_block", F.lit(0)), buckets
    if seen.hot:
        ranges = RANGES if earlier else 1
        plan = [(h.g, buckets + i, ceil(h.r / ROW_BLOCK / ranges), ceil(h.q / QUERY_BLOCK / ranges)) for i, h in enumerate(seen.hot)]
        cells += sum(ranges * ranges * a * b for *_, a, b in plan)
        hot = spark.createDataFrame(plan, "g string, hot_bucket long, row_cuts int, query_cuts int")
        cuts = F.array().cast("array<bigint>")
        if ranges > 1:  # only how evenly ids are dealt depends on these places
            places = rows.join(F.broadcast(hot), "g").groupBy("g").agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 1000).alias("cuts"))
            hot, cuts = hot.join(places, "g", "left"), F.coalesce("cuts", cuts)
        hot = F.broadcast(hot.withColumn("cuts", cuts))

        def dealt(side: DataFrame, key: str, mine: str, other: str, per: Column, others: Column, upto: bool) -> DataFrame:
            """Each row in its block, once for each block of the other side that it has to meet."""
            nth = F.size(F.filter("cuts", lambda c: c < F.col(key)))
            at = nth * per + F.pmod(F.xxhash64(key), per)
            meets = F.sequence(F.lit(0), ((nth + 1) * others - 1).cast("int")) if upto else F.sequence((nth * others).cast("int"), (F.lit(ranges) * others - 1).cast("int"))
            joined = side.drop("bucket", mine).join(hot, "g")
            return joined.select(*[c for c in side.columns if c not in ("bucket", mine)], F.col("hot_bucket").alias("bucket"), at.cast("int").alias(mine), F.explode(meets).alias(other))

        few = lambda side: side.join(hot.select("g"), "g", "left_anti")
        sent = few(sent).unionByName(dealt(rows, "id", "row_block", "query_block", F.col("row_cuts"), F.col("query_cuts"), False))
        met = few(met).unionByName(dealt(asked, "query_id", "query_block", "row_block", F.col("query_cuts"), F.col("row_cuts"), True))
    keys = ["bucket", "row_block", "query_block"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells, MAX_TASKS))  # by number: adaptive execution must not merge cells by their size
    found = sent.repartition(tasks, *keys).groupBy(*keys).cogroup(met.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(lambda left, right: _cell(left, right, k, earlier), "query_id long, id long, distance double")
    return _first(found, k)


def _cell(left: pd.DataFrame, right: pd.DataFrame, k: int, earlier: bool) -> pd.DataFrame:
    """The k best of the cell's rows for each of its queries, group by group."""
    out = []
    groups = left.groupby("g", sort=False).indices
    for g, mine in right.groupby("g", sort=False).indices.items():
        if g not in groups:
            continue
        theirs = groups[g]
        row_at, rows = usable(left["embedding"].iloc[theirs].tolist())
        query_at, asked = usable(right["vector"].iloc[mine].tolist())
        row_ids, query_ids = left["id"].to_numpy()[theirs], right["query_id"].to_numpy()[mine]
        for w in rows.keys() & asked.keys():
            ids, of = row_ids[row_at[w]], query_ids[query_at[w]]
            best = Best(len(of), k)
            for a in range(0, len(ids), ROW_TILE):
                for b in range(0, len(of), QUERY_TILE):
                    d = 1 - asked[w][b : b + QUERY_TILE] @ rows[w][a : a + ROW_TILE].T
                    if earlier:
                        d[ids[None, a : a + ROW_TILE] >= of[b : b + QUERY_TILE, None]] = np.inf
                    best.take(b, d, ids[a : a + ROW_TILE])
            q, nth = np.nonzero(best.d < np.inf)
            out.append(pd.DataFrame({"query_id": of[q], "id": best.ids[q, nth], "distance": best.d[q, nth]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": []})


def _block(df: DataFrame, found: list, k: int, within: str | None, earlier: bool) -> DataFrame:
    at, units = usable([r.vector for r in found])
    ids = {w: np.array([found[i].query_id for i in mine], dtype=np.int64) for w, mine in at.items()}
    groups: dict = {}
    if within:
        for r in found:
            if r[within] is not None:
                groups.setdefault(r[within], len(groups))
    of = {w: np.array([groups.get(found[i][within], -2) for i in mine]) for w, mine in at.items()} if within else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {w: Best(len(q), k) for w, q in units.items()}
        for pdf in batches:
            group = pdf[within].map(groups).fillna(-1).to_numpy(dtype=np.int64) if within else None
            if within:
                pdf, group = pdf[group >= 0], group[group >= 0]
            row_ids = pdf["id"].to_numpy(dtype=np.int64)
            places, rows = usable(pdf["embedding"].tolist())
            for w in rows.keys() & units.keys():
                for a in range(0, len(rows[w]), ROW_TILE):
                    x, here = rows[w][a : a + ROW_TILE], places[w][a : a + ROW_TILE]
                    for b in range(0, len(units[w]), QUERY_TILE):
                        tile = slice(b, b + QUERY_TILE)
                        d = 1 - units[w][tile] @ x.T
                        if within:
                            d[of[w][tile, None] != group[here][None, :]] = np.inf
                        if earlier:
                            d[row_ids[here][None, :] >= ids[w][tile, None]] = np.inf
                        best[w].take(b, d, row_ids[here])
        for w, found_here in best.items():
            q, nth = np.nonzero(found_here.d < np.inf)
            if len(q):
                yield pd.DataFrame({"query_id": ids[w][q], "id": found_here.ids[q, nth], "distance": found_here.d[q, nth]})

    return df.select("id", "embedding", *([within] if within else [])).mapInPandas(run, "query_id long, id long, distance double")
