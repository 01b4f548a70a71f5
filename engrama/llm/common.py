"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text: digits, a-z and everything beyond ASCII.
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words between ASCII white space.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


#: Folders of local masters, emptied when this process ends.
_LOCAL: set[str] = set()
#: Tables that this process wrote and has not dropped, by path.
_STORED: dict[str, Stored] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separator: str) -> Column:
    """Words of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir. Only a local master, where driver and
    executors are one process, may fall back to a folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"/tmp/engrama-shared-{spark.sparkContext.applicationId}"
    if path not in _LOCAL:
        _LOCAL.add(path)
        atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    return Stored(df, tag).df


class Stored:
    """A table in the shared folder, which can be dropped once nothing reads it any more."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = f"{shared_root(spark)}/engrama/{tag}-{uuid.uuid4().hex}"
        if not _STORED:
            atexit.register(_drop_all)
        _STORED[self.path] = self
        df.write.parquet(self.path)
        self.spark, self.df = spark, spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.pop(self.path, None)


def _drop_all() -> None:
    """At the end of the application nothing reads its tables any more."""
    for stored in list(_STORED.values()):
        try:
            stored.drop()
        except Exception:  # the JVM may be gone already; then the tables stay
            return


def gapless_start(df: DataFrame, by: list[str], order: list[str], salts: int, out: str) -> DataFrame:
    """Adds `out`: how many rows come before, within each value of `by`, where a row of df stands for n equal ones.

    df: distinct rows of the `by` and `order` columns, with n. Rows are dealt by (by, salt),
    where salt hashes the `order` columns; each cell is summed up on its own and moved up by
    the sizes of the cells before it, so no task holds a whole group, and equal rows, being
    one row with a count, crowd no cell. The cells are counts only: (values of `by`) x salts
    rows, broadcast after that many rows at most.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    cells = salted.groupBy(*by, "_salt").agg(F.sum("n").alias("_n"))
    starts = cells.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_salt").alias("_cell"), (F.sum("_n").over(_window(by, ["_salt"])) - F.col("_n")).alias("_start"))
    within = salted.withColumn("_local", F.sum("n").over(_window([*by, "_salt"], order)) - F.col("n"))
    on = F.col("_salt") == F.col("_cell")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = within.join(F.broadcast(starts), on, "left")
    return joined.withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_salt", "_cell", "_start", "_local", *[f"_by_{c}" for c in by])


#: Equal rows that are written out by one task at a time.
COPIES_A_BLOCK = 10_000


def spread(df: DataFrame, nth: str) -> DataFrame:
    """n rows for each row of df, with nth moved on by 0, 1, ...; rows that stand for very many are dealt out in blocks."""
    columns = [c for c in df.columns if c not in ("n", nth)]
    at = lambda start, n: F.explode(F.sequence(start, start + n - 1)).alias(nth)
    few = df.where(F.col("n") <= COPIES_A_BLOCK).select(*columns, at(F.col(nth), F.col("n")))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_A_BLOCK))).alias("_block")
    many = df.where(F.col("n") > COPIES_A_BLOCK).select(*columns, nth, "n", block).repartition(nth, "_block")
    done = F.col("_block") * COPIES_A_BLOCK
    many = many.select(*columns, at(F.col(nth) + done, F.least(F.col("n") - done, F.lit(COPIES_A_BLOCK))))
    return few.unionByName(many)


def meet(rows: DataFrame, keys: DataFrame, on: list[str], bound: int) -> DataFrame:
    """rows joined with keys (distinct in `on`; n: how many rows each meets, at least), with the columns of both.

    Keys that meet more than a `bound`-th part of all met rows are broadcast: they are fewer
    than `bound` however large the tables are. What they leave is joined by a shuffle, where
    a key brings no more than that part of the rows to a task.
    """
    found = keys.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    often = F.col("n") > found.rows // bound
    hot = F.broadcast(keys.where(often))
    met = rows.join(hot, on)
    if found.rows < bound:  # then every key is among them
        return met
    return met.unionByName(rows.join(hot.select(*on), on, "left_anti").join(keys.where(~often), on))


def _window(by: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as a struct, whatever their names), doc_id, text_key, text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))


def keyed(df: DataFrame) -> DataFrame:
    """Adds has_id and id, by which a null doc_id joins like any other value."""
    return df.withColumns({"has_id": F.col("doc_id").isNotNull(), "id": F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))})


ROW_KEY = ["has_id", "id", "text_key"]
