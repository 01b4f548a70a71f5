"""Verified copies of tables, and re-embedding that goes on where it was broken off."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.operators import codes
from engrama.operators.nearest import nearest

#: Ranges of ids that a re-embedding is done in.
RANGES = 64
PROGRESS = "nth int, low long, high long, n long, one decimal(38,0), two decimal(38,0)"
_WIDE = "decimal(38,0)"


class Mismatch(RuntimeError):
    """What was written is not what was to be written."""


def digest(df: DataFrame) -> DataFrame:
    """One row: n and two sums of row hashes, in which neither the order of rows nor of columns counts, but each value and each repeat does."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    columns += [c.isNull() for c in columns]  # hashing passes over nulls, so where they are is hashed too
    of = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast(_WIDE)), F.lit(0).cast(_WIDE)).cast(_WIDE)
    return df.agg(F.count(F.lit(1)).alias("n"), of(1).alias("one"), of(2).alias("two"))


def same(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.dtypes) == sorted(b.dtypes) and digest(a).first() == digest(b).first()


def verified_copy(df: DataFrame, path: str) -> DataFrame:
    """df as written to path and read from there; a copy that differs from df raises Mismatch."""
    df.write.mode("overwrite").parquet(path)
    copy = df.sparkSession.read.parquet(path)
    if not same(df, copy):
        raise Mismatch(f"{path} is not a copy of what was written there")
    return copy


def self_search(df: DataFrame, rows: int = codes.VERIFY_ROWS) -> DataFrame:
    """(query_id, distance): rows of df that do not find themselves, or one as near, first and within SELF_TOLERANCE; of the `rows` least hashed ids."""
    asked = df.orderBy(F.xxhash64("id"), "id").limit(rows).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = nearest(df, asked, 1)
    lost = asked.select("query_id").join(found.select("query_id", "distance"), "query_id", "left")
    return lost.where(F.col("distance").isNull() | (F.col("distance") > codes.SELF_TOLERANCE))


def reembed(df: DataFrame, loader: Callable, path: str, prefix: str = "", ranges: int = RANGES, column: str = "content", char_cap: int = 0) -> DataFrame:
    """df(id, content, ...) with its embedding made anew, range of ids by range of ids, below path.

    Each range is a folder of its own; after it is written, its bounds, its digest as read
    back and the digest of its source go to a table of progress. A run that was broken off
    goes on with the ranges that are missing from it; a range whose source or whose files
    have changed since is done again. So it can be repeated until it ends, and what it
    returns has been compared with its digests.
    """
    spark = df.sparkSession
    source = df.drop("embedding")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/progress")
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    done = {r.nth: r for r in spark.read.schema(f"{PROGRESS}, source_one {_WIDE}, source_two {_WIDE}").parquet(f"{path}/progress").collect()} if there else {}  # a row a range, and one for each time it was done again
    bounds = _bounds(spark, path) if there else _plan(source, path, ranges)
    parts = []
    for nth, (low, high) in enumerate(bounds):
        mine = source.where((F.col("id") > low) & (F.col("id") <= high))
        before = digest(mine).first()
        at, row = f"{path}/range={nth}", done.get(nth)
        if row is None or (before.one, before.two) != (row.source_one, row.source_two) or not _intact(spark, at, row):
            codes.embed(mine, column, loader, prefix, char_cap=char_cap).write.mode("overwrite").parquet(at)
            written = digest(spark.read.parquet(at)).first()
            if written.n != before.n:
                raise Mismatch(f"{at} holds {written.n} of {before.n} rows")
            new = [(nth, low, high, written.n, written.one, written.two, before.one, before.two)]
            kept = [tuple(r) for n, r in sorted(done.items()) if n != nth]
            table = spark.createDataFrame(kept + new, f"{PROGRESS}, source_one {_WIDE}, source_two {_WIDE}")
            done = {r.nth: r for r in table.collect()}
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/progress")
        parts.append(at)
    return spark.read.option("basePath", path).parquet(*parts).drop("range")


def _plan(source: DataFrame, path: str, ranges: int) -> list[tuple[int, int]]:
    """Bounds (over, up to] of ranges of about as many rows each, kept so that a later run has the same."""
    low, high, cuts = source.agg(F.min("id"), F.max("id"), F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()
    if low is None:
        edges = [-1, 0]
    else:
        edges = sorted({low - 1, high, *[c for c in (cuts if ranges > 1 else []) if low <= c < high]})
    out = list(zip(edges, edges[1:], strict=False))
    source.sparkSession.createDataFrame(out, "low long, high long").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return out


def _bounds(spark, path: str) -> list[tuple[int, int]]:
    return [(r.low, r.high) for r in spark.read.parquet(f"{path}/bounds").orderBy("low").collect()]


def _intact(spark, at: str, row) -> bool:
    """Whether a range's files still hold what was written; what cannot be read does not."""
    try:
        found = digest(spark.read.parquet(at)).first()
    except (PySparkException, Py4JError):
        return False
    return (found.n, found.one, found.two) == (row.n, row.one, row.two)
