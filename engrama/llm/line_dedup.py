"""Line dedup: lines that stand on many distinct sites are boilerplate and go.

Native: DataFrame functions only. A line is known by two independent 64-bit hashes of its
trimmed text and its length. Lines are first counted, which leaves the few that are frequent
enough; HyperLogLog sketches of the sites and of the texts that hold these merge by
aggregation (combined before the shuffle, so a line in a third of all rows is no hot key).
A line whose estimates are clear of the threshold is decided by them; lines near it get
exact distinct counts. Counting texts as well as sites leaves exact copies of one document
to the near-duplicate operator: a line that only one text holds is no boilerplate.

Lines of fewer than MIN_WORDS words are shared by chance more easily, so they must stand
SHORT_FACTOR times as wide.

Defined cases: a null text stays null; a null source counts as a site of its own; lines
without a word stay; equal rows get equal results; a document all of whose
lines go keeps an empty text; columns other than text stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ROW_KEY, keyed, materialize, meet, packed

#: A line on so many distinct sites, in so many distinct texts, is boilerplate.
MIN_SITES = 5
MIN_WORDS = 3
SHORT_FACTOR = 2
#: log2 of a sketch's registers; three standard errors around the threshold are counted exactly.
LG_K = 12
BAND = 3 * 1.04 / (1 << (LG_K // 2))
#: Of a table of lines so many are broadcast at most: those that meet the most rows.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


KEY = ["line", "line2", "len", "short"]


def _keys(line: Column, min_words: int) -> list[Column]:
    """By what a line is known, and whether it is short."""
    bare = F.trim(line)
    short = F.size(F.split(bare, ASCII_SPACE)) < min_words
    return [F.xxhash64(bare).alias("line"), F.xxhash64(F.lit(1), bare).alias("line2"), F.length(bare).alias("len"), short.alias("short")]


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(site_key, text_key, *KEY): a row for each line with a word."""
    rows = docs.select(F.xxhash64(F.coalesce("source", F.lit(""))).alias("site_key"), F.xxhash64("text").alias("text_key"), F.explode(_lines(F.col("text"))).alias("l"))
    return rows.where(_has_word(F.col("l"))).select("site_key", "text_key", *_keys(F.col("l"), min_words))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY of each boilerplate line, and n: how often it occurs."""
    lines = line_table(docs, min_words)
    need = F.when(F.col("short"), min_sites * SHORT_FACTOR).otherwise(min_sites)
    # plain counts, since nearly all lines occur once: no sketch is built for these, nor for lines of one site or of one text
    seen = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("site_key", "text_key") for f in (F.min, F.max)])
    several = (F.col("min_site_key") < F.col("max_site_key")) & (F.col("min_text_key") < F.col("max_text_key")) | (need <= 1)
    frequent = materialize(seen.where((F.col("n") >= need) & several).select(*KEY, "n"), "line-counts")
    lines = materialize(meet(lines, frequent, KEY, BROADCAST_LINES), "line-frequent")  # hashes only; read twice below
    spread = lines.groupBy(*KEY, "n").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site_key", F.lit(LG_K))).alias("sites"), F.hll_sketch_estimate(F.hll_sketch_agg("text_key", F.lit(LG_K))).alias("texts")
    )
    margin = F.greatest(F.lit(1.0), need * BAND)
    spread = materialize(spread.where((F.col("sites") >= need - margin) & (F.col("texts") >= need - margin)), "line-spread")
    sure = (F.col("sites") > need + margin) & (F.col("texts") > need + margin)
    counted = _exact(meet(lines.drop("n"), spread.where(~sure).select(*KEY, "n"), KEY, BROADCAST_LINES)).where((F.col("s") >= need) & (F.col("t") >= need)).select(*KEY, "n")
    return materialize(spread.where(sure).select(*KEY, "n").unionByName(counted), "boilerplate")


def _exact(lines: DataFrame) -> DataFrame:
    """(*KEY, n, s, t): exact distinct sites and texts, each pair reduced before it is counted."""
    each = F.array(F.struct(F.lit(0).alias("kind"), F.col("site_key").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("text_key").alias("v")))
    both = lines.select(*KEY, "n", F.explode(each).alias("x")).distinct()
    return both.groupBy(*KEY, "n").agg(F.count(F.when(F.col("x.kind") == 0, 1)).alias("s"), F.count(F.when(F.col("x.kind") == 1, 1)).alias("t"))


def removals(docs: DataFrame, known: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, gone): positions (from 0) of the boilerplate lines of documents that have any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode(_lines(F.col("text"))).alias("at", "l"))
    hits = meet(rows.where(_has_word(F.col("l"))).select("doc_id", "text_key", "at", *_keys(F.col("l"), min_words)), known, KEY, BROADCAST_LINES)
    return hits.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("gone"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with boilerplate lines taken out of text, and the columns n_lines and n_removed (renamed if docs has them)."""
    known = boilerplate(docs, min_sites, min_words)
    gone = keyed(materialize(removals(docs, known, min_words), "line-removals")).select(*ROW_KEY, "gone")
    lines = F.col("lines")
    rows = keyed(packed(docs)).select("row", *ROW_KEY).join(gone, ROW_KEY, "left")  # the text travels once, in row
    rows = rows.select("row", "gone", F.col("row").getField("text").alias("text")).withColumn("lines", F.when(F.col("gone").isNotNull(), _lines(F.col("text"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")  # by a hash set: linear
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    free = lambda name: name if name not in docs.columns else free(f"line_{name}")
    return rows.select(
        F.col("row").withField("text", text).alias("row"),
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    ).select("row.*", F.col("n_lines").alias(free("n_lines")), F.col("n_removed").alias(free("n_removed")))
