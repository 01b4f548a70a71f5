"""Vector arithmetic as columns, in doubles, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, null for a zero vector."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, 1.0 - dot(a, b) / n))


def unit(v: Column | str) -> Column:
    """The unit vector, null for a zero vector: pairs of units need one product each for their distance."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(_double(v), lambda x: x / n)))


def score(distance: Column | str) -> Column:
    """clamp(1 - d / 2, 0, 1); 0.5 for no distance."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.when(d.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - d / 2)))


def norm_of_any_order(v: Column | str) -> Column:
    """The norm, to the last bit the same for the components in another order."""
    return F.sqrt(F.aggregate(F.array_sort(F.transform(_double(v), lambda x: x * x)), F.lit(0.0), lambda s, x: s + x))


def normalize(v: Column | str, length: Callable[[Column | str], Column] = norm) -> Column:
    """The unit vector; zeros where the norm is under TINY."""
    return let(length(v), lambda n: F.transform(_double(v), lambda x: F.when(n < TINY, F.lit(0.0)).otherwise(x / n)))


def truncate(v: Column | str, dim: int) -> Column:
    """The first dim components, renormalised; as is if there are no more, or they are all zero."""
    head = F.slice(_double(v), 1, dim)
    return F.when(F.size(_double(v)) <= dim, _double(v)).when(norm(head) == 0, head).otherwise(normalize(head))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def space_offset(document: Column | str, query: Column | str) -> Column:
    """normalise(document) - normalise(query), null where shapes differ or a value is not finite; exactly 0 where vectors of one norm agree."""
    finite = lambda v: ~F.exists(_double(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(_double(document)) == F.size(_double(query))) & finite(document) & finite(query), minus(normalize(document, norm_of_any_order), normalize(query, norm_of_any_order)))


def blend(v: Column | str, cue: Column | str, step: Column | float) -> Column:
    """normalise((1 - step) v + step cue); v itself if step is not positive, shapes differ or the norm is zero."""
    s = F.lit(step) if isinstance(step, (int, float)) else step
    mixed = F.zip_with(_double(v), _double(cue), lambda x, y: (1 - s) * x + s * y)
    fits = (s > 0) & (F.size(_double(v)) == F.size(_double(cue))) & (norm(mixed) > 0)
    return F.when(fits, normalize(mixed)).otherwise(_double(v))


def rounded(v: Column | str, digits: int) -> Column:
    """Components rounded as SQL's round does it: scaled, half away from zero, a rounded-off negative one is -0.0."""
    scale = 10.0**digits

    def one(x: Column) -> Column:
        y = x * scale
        return F.when((x == 0) | (F.abs(y) == float("inf")), x).when(x < 0, -(F.round(-y) / scale)).otherwise(F.round(y) / scale)

    return F.transform(_double(v), one)
