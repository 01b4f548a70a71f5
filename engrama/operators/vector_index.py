"""An inverted-file index of vectors: lists around centroids, rows written since, and a guard.

Centroids are fitted on a bounded sample; every row of the store is assigned to the list of
its nearest centroid. A query looks into the lists of its nearest centroids, `probes` of
them, and beside that at every row that the index does not hold, or holds with another
vector: these are pending and are searched exactly. Whether a row is pending follows from
the store itself (its id and a hash of its vector), so there is no buffer that can be lost.

How many lists are probed is calibrated: bounded queries are searched exactly, and the
smallest number is taken that would have found TARGET of their neighbours. `nearest` stays
the exact way.

Defined cases: unusable vectors (null, empty, zero, not finite) are in no list and never
pending; vectors of another width than most have no list and stay pending, so they are
searched exactly; without any usable vector there is one list and no probe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.operators.nearest import in_grid, nearest, usable

#: Rows that centroids are fitted on, those of the least hashed ids; lists at most; queries that the number of probes is measured by.
SAMPLE, MAX_LISTS, CALIBRATION = 16_384, 1024, 200
ROUNDS = 8
TARGET = 0.95


@dataclass(frozen=True)
class Centroids:
    """Unit vectors of the lists, and how many of them a query looks into."""

    units: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.units.shape[1]


def searchable(vector: str = "embedding") -> Column:
    """Rows that can be found at all."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def key(vector: str = "embedding") -> Column:
    return F.xxhash64(F.col(vector).cast("array<double>"))


def fit(df: DataFrame, lists: int | None = None, seed: int = 0) -> Centroids:
    """Spherical k-means over a sample of df(id, embedding); probes: all, until calibrated."""
    rows = df.where(searchable())
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return Centroids(np.zeros((1, 1)), 1)
    width, n = widths
    lists = max(1, min(lists or round(sqrt(n)), MAX_LISTS, n))
    drawn = rows.where(F.size("embedding") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    x = next(iter(usable([r.embedding for r in drawn])[1].values()))
    rng = np.random.default_rng(seed)
    units = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        of = np.argmax(x @ units.T, axis=1)
        sums = np.zeros_like(units)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1)
        lost = norm < 1e-12  # a list without rows begins anew at a row
        sums[lost], norm[lost] = x[rng.choice(len(x), int(lost.sum()))], 1.0
        units = sums / norm[:, None]
    return Centroids(units, len(units))


def assign(df: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, key, list, embedding) of the searchable rows of the centroids' width."""
    units = centroids.units

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, rows = usable(pdf["embedding"].tolist())
            if units.shape[1] in rows:
                at = places[units.shape[1]]
                yield pdf.iloc[at].assign(list=np.argmax(rows[units.shape[1]] @ units.T, axis=1).astype(np.int32))[["id", "key", "list", "embedding"]]

    kind = df.schema["embedding"].dataType.simpleString()
    return df.where(searchable()).select(F.col("id").cast("long").alias("id"), key().alias("key"), "embedding").mapInPandas(run, f"id long, key long, list int, embedding {kind}")


def pending(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of the store that no entry stands for: new ones, and those whose vector has changed."""
    return df.where(searchable()).withColumn("key", key()).join(entries.select("id", "key"), ["id", "key"], "left_anti").drop("key")


def stale(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose row is gone or has another vector."""
    return entries.join(df.select("id", key().alias("key")), ["id", "key"], "left_anti")


def reconciled(df: DataFrame, entries: DataFrame, centroids: Centroids) -> DataFrame:
    """The entries without the stale ones, and with those of the pending rows."""
    kept = entries.join(df.select("id", key().alias("key")), ["id", "key"], "left_semi").select("id", "key", "list", "embedding")
    return kept.unionByName(assign(pending(df, entries), centroids))


def guard(df: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: n_store (searchable rows), n_index, n_pending, n_stale, behind."""
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    out = count(df.where(searchable()), "n_store")
    for d, name in ((entries, "n_index"), (pending(df, entries), "n_pending"), (stale(df, entries), "n_stale")):
        out = out.join(F.broadcast(count(d, name)))
    return out.withColumn("behind", (F.col("n_pending") > 0) | (F.col("n_stale") > 0))


def probed(queries: DataFrame, centroids: Centroids, probes: int | None = None) -> DataFrame:
    """(query_id, vector, list, place): the lists nearest to each query, from place 1 on."""
    units, take = centroids.units, min(probes or centroids.probes, len(centroids.units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, rows = usable(pdf["vector"].tolist())
            if units.shape[1] in rows:
                near = np.argsort(-(rows[units.shape[1]] @ units.T), axis=1, kind="stable")[:, :take]
                mine = pdf.iloc[np.repeat(places[units.shape[1]], take)][["query_id", "vector"]]
                yield mine.assign(list=near.ravel().astype(np.int32), place=np.tile(np.arange(1, take + 1, dtype=np.int32), len(near)))

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInPandas(run, f"query_id long, vector {kind}, list int, place int")


def calibrated(entries: DataFrame, centroids: Centroids, queries: DataFrame, k: int, target: float = TARGET) -> Centroids:
    """The centroids with the least number of probes that finds `target` of the k exact neighbours of bounded queries."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION)
    true = nearest(entries, asked, k).join(entries.select("id", "list"), "id")
    at = true.join(probed(asked, centroids, len(centroids.units)), ["query_id", "list"]).groupBy("place").count().orderBy("place").collect()  # one row a list at most
    need, upto = target * sum(r["count"] for r in at), 0
    for r in at:
        upto += r["count"]
        if upto >= need:
            return Centroids(centroids.units, int(r["place"]))
    return centroids


def search(df: DataFrame, entries: DataFrame, centroids: Centroids, queries: DataFrame, k: int, probes: int | None = None, current: bool = False) -> DataFrame:
    """(query_id, id, distance, nth): about the k nearest rows of the store df(id, embedding) of each of queries(query_id, vector).

    current: the guard has found nothing pending or stale, so entries are not compared with the store.
    """
    asked = probed(queries, centroids, probes)
    lists = [r["list"] for r in asked.select("list").distinct().collect()]  # MAX_LISTS at most; only their files are read
    live = entries.where(F.col("list").isin(lists))
    if not current:
        live = live.join(df.select("id", key().alias("key")), ["id", "key"], "left_semi")
    found = in_grid(live, asked, k, within="list").select("query_id", "id", "distance")
    if not current:
        found = found.unionByName(nearest(pending(df, entries), queries, k).select("query_id", "id", "distance"))
    found = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


class VectorIndex:
    """An index in a folder: lists as partitions of a Parquet table, beside them the centroids, written last.

    ready() is the guard: once for each object it compares the index with the store, builds
    it if there is none, and otherwise rewrites the lists that are behind, and no others. If
    that fails, the next call tries again.
    """

    def __init__(self, spark: SparkSession, root: str, lists: int | None = None):
        self.spark, self.root, self.lists = spark, root.rstrip("/"), lists
        self._centroids: Centroids | None = None
        self._ready = False

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/centroids/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lists")

    def centroids(self) -> Centroids:
        if self._centroids is None:
            rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("list").collect()  # MAX_LISTS at most
            self._centroids = Centroids(np.array([r.unit for r in rows]), rows[0].probes)
        return self._centroids

    def build(self, df: DataFrame, k: int = 10) -> None:
        centroids = fit(df, self.lists)
        entries = assign(df, centroids)
        entries.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{self.root}/lists") if centroids.width > 1 else entries.write.mode("overwrite").parquet(f"{self.root}/lists")
        entries = self.entries()
        centroids = calibrated(entries, centroids, entries.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), k)
        rows = [(i, [float(x) for x in u], centroids.probes) for i, u in enumerate(centroids.units)]
        self.spark.createDataFrame(rows, "list int, unit array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")
        self._centroids = centroids

    def ready(self, df: DataFrame) -> bool:
        """Whether anything had to be written."""
        if self._ready:
            return False
        if not self._there():
            if df.where(searchable()).isEmpty():
                return False
            self.build(df)
            self._ready = True
            return True
        wrote = self.flush(df)
        self._ready = True
        return wrote

    def flush(self, df: DataFrame) -> bool:
        """Takes the pending rows into their lists and the stale entries out; only lists that change are written."""
        from engrama.operators.shared import cut

        entries, centroids = self.entries(), self.centroids()
        more = cut(assign(pending(df, entries), centroids))
        gone = cut(stale(df, entries).select("id", "key", "list"))
        touched = [r["list"] for r in more.select("list").unionByName(gone.select("list")).distinct().collect()]  # MAX_LISTS at most
        if not touched:
            return False
        old = entries.where(F.col("list").isin(touched)).join(gone, ["id", "key", "list"], "left_anti").select("id", "key", "embedding", "list")
        now = cut(old.unionByName(more.select(old.columns)))
        kept = {r["list"] for r in now.select("list").distinct().collect()}
        now.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.root}/lists")
        for emptied in set(touched) - kept:  # a list without rows has no partition to overwrite
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lists/list={emptied}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return True

    def search(self, df: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """After the guard; rows written since then are searched exactly."""
        self.ready(df)
        if not self._there():
            return nearest(df, queries, k)
        return search(df, self.entries(), self.centroids(), queries, k, probes)
