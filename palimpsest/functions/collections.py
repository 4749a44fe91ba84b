"""Array helpers built from higher-order functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An expression captured by a lambda is evaluated again for every element;
    a lambda variable is not, so the value travels as one: the start of an
    aggregate over no elements, whose last step is ``body``. A transform of one
    element would copy the whole result, once more for every level of nesting.
    """
    return F.aggregate(F.array().cast("array<boolean>"), value, lambda same, _: same, body)


def bound(n: int):
    """Decorator: evaluate the first ``n`` Column arguments once per row, so the
    function may use them inside lambdas whatever expressions it is given."""

    def wrap(fn):
        @wraps(fn)
        def call(*args, **kwargs):
            packed = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(args[:n])])
            return bind(
                packed, lambda x: fn(*[x[f"_{i}"] for i in range(n)], *args[n:], **kwargs)
            )

        return call

    return wrap


def present(value: Column) -> Column:
    """Generator: the fields of a struct as columns, no row where it is null.

    A filter on the struct would be moved below the step that makes it, which
    then makes it twice, and below a repartition in front of that.
    """
    return F.inline(F.filter(F.array(value), lambda x: x.isNotNull()))


def index_range(n: Column) -> Column:
    """``[0, 1, .., n-1]``, empty for ``n <= 0``."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def run_bounds(a: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Split an array into runs of neighbours for which ``same(prev, cur)`` holds.

    Returns ``array<struct<lo:int,hi:int>>`` with 0-based inclusive ends, in
    one linear pass over the array.
    """
    n = F.size(a)
    starts = F.filter(
        index_range(n), lambda i: (i == 0) | ~F.coalesce(same(F.get(a, i - 1), F.get(a, i)), F.lit(False))
    )
    return bind(
        starts,
        lambda s: F.transform(
            s,
            lambda lo, k: F.struct(
                lo.alias("lo"), (F.coalesce(F.get(s, k + 1), n) - 1).cast("int").alias("hi")
            ),
        ),
    )


def numbered_copies(a: Column) -> Column:
    """Turn a string array into a set: first occurrences as they are, further
    ones tagged with their number.

    The size of an ``array_intersect`` of two results is the size of the
    multiset intersection. Sort plus linear passes; only repeated elements are
    touched one by one.
    """

    def repeated(s: Column) -> Column:
        at = F.filter(
            index_range(F.size(s)), lambda i: F.coalesce(F.get(s, i) == F.get(s, i - 1), F.lit(False))
        )
        return F.transform(at, lambda i: F.get(s, i))

    def tagged(d: Column) -> Column:
        return F.flatten(
            F.transform(
                run_bounds(d, lambda x, y: x == y),
                lambda r: F.transform(
                    F.sequence(F.lit(0), r["hi"] - r["lo"]),
                    lambda k: F.concat(F.get(d, r["lo"]), F.lit("\u0002"), k.cast("string")),
                ),
            )
        )

    return bind(F.sort_array(a), lambda s: F.concat(F.array_distinct(s), bind(repeated(s), tagged)))


def prefix_sums(sizes: Column, block: int = 256) -> Column:
    """Exclusive prefix sums, one longer than the input (last = total).

    Sums run inside blocks and over block totals, so that no growing array is
    copied once per element.
    """

    def running(a: Column, start: Column) -> Column:
        return F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def inside(a: Column) -> Column:
        starts = F.filter(index_range(F.size(a)), lambda i: i % block == 0)
        return F.transform(starts, lambda i: running(F.slice(a, i + 1, F.lit(block)), F.lit(0)))

    def joined(parts: Column) -> Column:
        bases = running(F.transform(parts, lambda p: F.element_at(p, -1)), F.lit(0))
        moved = bind(
            bases,
            lambda b: F.transform(
                parts, lambda p, k: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: x + F.get(b, k))
            ),
        )
        return F.concat(F.array(F.lit(0)), F.flatten(moved))

    return bind(sizes, lambda a: bind(inside(a), joined))


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, left to right."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
