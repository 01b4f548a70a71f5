"""Places in an order: the value at a place, and pages of a table by offset, without sorting the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_at(df: DataFrame, column: str, place: int, n: int):
    """The value at a place (from 0) of the ascending column of n values, none null.

    Mergeable sketches give values on both sides of the place; what lies between them, a few
    ten-thousandths of the rows, is grouped and counted up to the place, so it is exact.
    """
    around = 2e-4
    while True:
        low, high = df.agg(F.percentile_approx(column, [max(0.0, place / n - around), min(1.0, place / n + around)], 10_000)).first()[0]
        upto = df.where(F.col(column) < low).count()
        if upto <= place:
            for value, count in df.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(column).toLocalIterator():
                upto += count
                if upto > place:
                    return value
        around *= 8


#: A page is looked up in a range of about so many rows; ranges that are counted at a time.
RANGE_ROWS, RANGES = 65_536, 256


def page(df: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows offset to offset + limit of df in the order of a key without nulls, without sorting df.

    Sketches cut the keys into ranges, one aggregation counts them, and prefix sums turn the
    offset into a range and a place in it; a range that is still large is cut again. Only
    the ranges of the page are read for it, by a filter that reaches the scan.
    """
    rows, skip = df, max(0, offset)
    while True:
        n, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000)).first()
        if n <= RANGE_ROWS:
            break
        cuts = sorted(set(cuts))
        at = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(key)))  # range i: over cuts[i - 1], up to cuts[i]
        counts = {r.i: r["count"] for r in rows.groupBy(at.alias("i")).count().collect()}  # RANGES at most
        first, upto, before = None, 0, 0
        for i in range(len(cuts) + 1):
            if first is None and upto + counts.get(i, 0) > skip:
                first, before = i, upto
            upto += counts.get(i, 0)
            if upto >= skip + limit:
                break
        if first is None:  # beyond the end
            return df.limit(0)
        low, high = cuts[first - 1] if first else None, cuts[i] if i < len(cuts) else None
        rows = rows.where(F.col(key) > low) if low is not None else rows
        rows = rows.where(F.col(key) <= high) if high is not None else rows
        skip -= before
        if upto - before >= n or limit >= upto - before - skip >= RANGE_ROWS:  # one key, or a page of more than a range
            break
    return rows.orderBy(key).offset(skip).limit(limit)
