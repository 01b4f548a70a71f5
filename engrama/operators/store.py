"""Scans and changes of snapshot tables: every change is a new DataFrame, committed by writing it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engrama.operators.ordered import page

#: Id lists of up to so many values become an IN filter, longer ones a join.
IN_LIST = 1000
#: A range of a table: the keys from one multiple of it up to the next. A change rewrites whole ranges.
SPAN = 65_536


def matches(filters: dict) -> Column:
    """Equality, or IN for a list of values; all must hold."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & (F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return out


def scan_page(df: DataFrame, filters: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of the rows that match, in id order; with a limit it is looked up by ranges of ids, so the table is not sorted."""
    out = df.where(matches(filters)) if filters else df
    if limit is not None:
        return page(out, limit, offset)
    return out.orderBy("id").offset(offset) if offset else out.orderBy("id")


def scan_window(df: DataFrame, cursor: int, max_scan: int) -> tuple[DataFrame, int]:
    """The page at a rotating cursor and the next cursor: 0 once the page comes out short."""
    page = scan_page(df, limit=max_scan, offset=cursor)
    n = page.count()
    return page, (cursor + n if n == max_scan else 0)


def by_ids(df: DataFrame, ids: DataFrame | Sequence[int], key: str = "id") -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    if len(ids) <= IN_LIST:
        return df.where(F.col(key).isin([int(i) for i in ids]))
    return df.join(df.sparkSession.createDataFrame([(int(i),) for i in ids], f"{key} long"), key, "left_semi")


def next_ids(df: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """new with ids after the largest of df, in the given order.

    Ranges of the order are sized first, so numbering takes no single task.
    """
    top = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    ranged = new.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").count()
    starts = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_at"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", local).join(F.broadcast(starts), "_p").withColumn("id", F.lit(top) + F.col("_at") + F.col("_n")).drop("_p", "_n", "_at")


def append_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new, allowMissingColumns=True)


def patch_rows(df: DataFrame, patch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Sets the patch's columns where they are not null; of several patches of an id the last by `order` wins for each column."""
    names = [c for c in patch.columns if c not in (key, order)]
    if order:
        patch = patch.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in names])
    patch = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = df.join(patch, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


def increment_rows(df: DataFrame, deltas: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Adds the sum of each id's deltas."""
    total = deltas.groupBy(key).agg(F.sum("delta").alias("_delta"))
    return df.join(total, key, "left").select(*[(F.coalesce(column, F.lit(0)) + F.coalesce("_delta", F.lit(0))).cast(df.schema[column].dataType).alias(column) if c == column else F.col(c) for c in df.columns])


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def delete_cascade(docs: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and edges without the ids at either end."""
    return delete_ids(docs, ids), delete_ids(delete_ids(edges, ids, "src_id"), ids, "dst_id")


def edge_upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces whole edges by (kind, src_id, dst_id)."""
    return edges.join(new.select("kind", "src_id", "dst_id"), ["kind", "src_id", "dst_id"], "left_anti").unionByName(new)


def event_log_tail(log: DataFrame, capacity: int) -> DataFrame:
    """The newest `capacity` events: seq at least the last seq less capacity, plus 1."""
    last = log.agg(F.max("seq").alias("last")).first().last
    return log.where(F.col("seq") >= (last or 0) - capacity + 1)


class Conflict(RuntimeError):
    """Another writer committed in between."""


class Ranges(NamedTuple):
    """A change of a table that is laid out by ranges of a key: the rows that the given ranges now hold; ranges None: the whole table."""

    df: DataFrame
    key: str
    ranges: Sequence[int] | None = None


class Store:
    """Named tables as Parquet snapshots under root/name/, and numbered commits that say which snapshots are current.

    A commit first writes its tables, each into a folder of its own, and then one manifest,
    root/_commits/N.json, by a rename that fails if N is there. So a commit of several
    tables shows whole or not at all, and of two writers that began at the same commit one
    gets a Conflict; what a failed writer left is never read and goes with `vacuum`.

    A table committed as `Ranges` is partitioned by key div span. The manifest names the
    folder of each range, so a change of a few rows writes their ranges and names the other
    ranges' old folders again. A manifest is one line for each range: at 65,536 rows a
    range, 10^10 rows are 150,000 lines.
    """

    def __init__(self, spark: SparkSession, root: str, span: int = SPAN):
        self.spark, self.root, self.span = spark, root.rstrip("/"), span
        self._known: dict[int, dict[str, dict]] = {}

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}" if rest else self.root)

    def _names(self, rest: str) -> list[str]:
        """What a folder holds; nothing, if there is none."""
        fs, path = self._fs(), self._path(rest)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def commits(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The last commit, 0 before the first."""
        return max(self.commits(), default=0)

    def _manifest(self, commit: int) -> dict[str, dict]:
        """table -> its last commit, schema, span (0: not by ranges) and parts, range -> folder, as of a commit."""
        if commit and commit not in self._known:
            stream = self._fs().open(self._path(f"_commits/{commit}.json"))
            try:
                found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            # a manifest of before there were ranges names one folder a table
            self._known[commit] = {n: {"commit": int(e[2:].split("-")[0]), "schema": None, "span": 0, "parts": {"": e}} if isinstance(e, str) else e for n, e in found.items()}
        return self._known.get(commit, {})

    def _present(self, name: str) -> set[str]:
        """The folders of a table and those of ranges in them."""
        tops = self._names(name)
        return set(tops) | {f"{t}/{r}" for t in tops for r in self._names(f"{name}/{t}") if r.startswith("_range=")}

    def versions(self, name: str) -> list[int]:
        """The commits that changed a table and can still be read."""
        present = self._present(name)
        mine = [(c, self._manifest(c).get(name)) for c in self.commits()]
        return [c for c, entry in mine if entry and entry["commit"] == c and present.issuperset(entry["parts"].values())]

    def read(self, name: str, version: int | None = None, ranges: Iterable[int] | None = None) -> DataFrame:
        """A table as of a commit, by default the last; with ranges, of a table that has them, only the files of these."""
        entry = self._manifest(self.latest() if version is None else version).get(name)
        if entry is None:
            raise KeyError(f"no table {name} in {self.root}")
        parts = entry["parts"]
        if ranges is not None and entry["span"]:
            parts = {r: parts[r] for r in map(str, ranges) if r in parts}
        schema = StructType.fromJson(entry["schema"]) if entry["schema"] else None
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*[f"{self.root}/{name}/{folder}" for folder in parts.values()])

    def ranges_of(self, name: str, keys: DataFrame, version: int | None = None) -> list[int] | None:
        """The ranges of a table that keys (id) fall into; None if it has no ranges (yet), so that only the whole can be written."""
        entry = self._manifest(self.latest() if version is None else version).get(name)
        if entry is None or not entry["span"]:
            return None
        found = keys.select(F.expr(f"id div {entry['span']}").alias("r")).where("r is not null").distinct()
        return sorted(row.r for row in found.collect())  # at most one for each line of the manifest, and new ones at the end

    def commit(self, name: str, df: DataFrame | Ranges) -> int:
        return self.commit_all({name: df})

    def _write(self, name: str, folder: str, change: DataFrame | Ranges, old: dict | None) -> dict:
        path = f"{self.root}/{name}/{folder}"
        if isinstance(change, DataFrame):
            change.write.parquet(path)
            return {"schema": change.schema.jsonValue(), "span": 0, "parts": {"": folder}}
        df, key, ranges = change
        if ranges is not None and not (old and old["span"]):
            raise ValueError(f"table {name} has no ranges yet")
        span = self.span if ranges is None else old["span"]
        # a range is rebalanced by size, so one that a hub makes large is written by several tasks
        df.withColumn("_range", F.expr(f"`{key}` div {span}")).hint("rebalance", F.col("_range")).write.partitionBy("_range").parquet(path)
        written = {n[len("_range="):]: f"{folder}/{n}" for n in self._names(f"{name}/{folder}") if n.startswith("_range=")}
        if ranges is None:
            return {"schema": df.schema.jsonValue(), "span": span, "parts": written}
        given = set(map(str, ranges))
        if stray := sorted(set(written) - given):
            raise ValueError(f"table {name}: rows of the ranges {stray[:5]}, which the change does not name")
        return {"schema": df.schema.jsonValue(), "span": span, "parts": {r: f for r, f in old["parts"].items() if r not in given} | written}

    def commit_all(self, tables: dict[str, DataFrame | Ranges], base: int | None = None) -> int:
        """Writes tables as one commit after `base`, the commit that they were made from; by default the last."""
        base = self.latest() if base is None else base
        if self.latest() != base:
            raise Conflict(f"commit {base} of {self.root} is no longer the last")
        number, mine = base + 1, uuid.uuid4().hex
        manifest = dict(self._manifest(base))
        for name, change in tables.items():
            manifest[name] = {"commit": number} | self._write(name, f"v={number}-{mine}", change, manifest.get(name))
        fs, draft = self._fs(), self._path(f"_commits/draft-{mine}")
        out = fs.create(draft, False)
        out.writeBytes(json.dumps(manifest))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(self.spark._jsc.hadoopConfiguration()), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(self._path(f"_commits/{number}.json")), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as failed:
            fs.delete(draft, False)
            if number in self.commits():
                raise Conflict(f"commit {number} of {self.root} is another writer's") from failed
            raise
        return number

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Drops a table's folders but for those that its last `keep` versions read; call it while nobody writes."""
        entries = [self._manifest(c)[name] for c in self.versions(name)[-keep:]] + [e for e in [self._manifest(self.latest()).get(name)] if e]
        kept = {folder for e in entries for folder in e["parts"].values()}
        tops, fs = {folder.split("/")[0] for folder in kept}, self._fs()
        for folder in self._present(name) - kept:
            top, _, part = folder.partition("/")
            if (part and top in tops) or (not part and top not in tops):
                fs.delete(self._path(f"{name}/{folder}"), True)
