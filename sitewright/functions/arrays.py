"""Arrays as column expressions, with work that stays near their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plus(a: Column, b: Column) -> Column:
    return a + b


def greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, op: Callable[[Column, Column], Column] = plus) -> Column:
    """What op (plus or greater) has made of an array of whole numbers, none negative, up to each of its places.

    A fold that appends copies what it has at every step. It goes by blocks of about the root of the array's length, so n
    values cost n to the power of 1.5 at most.
    """
    zero = F.lit(0).cast("bigint")

    def folded(first: Column, array: Column) -> Column:
        return F.aggregate(array, F.array(first), lambda done, x: F.concat(done, F.array(op(F.element_at(done, F.lit(-1)), x))))

    def by_blocks(array: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(array))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / width).cast("int")), lambda k: F.slice(array, k * width + 1, width))
        whole = lambda blocks: folded(zero, F.transform(blocks, lambda x: F.aggregate(x, zero, op)))
        return let(blocks, lambda blocks: let(whole(blocks), lambda before: F.flatten(F.transform(blocks, lambda x, k: F.slice(folded(F.get(before, k), x), F.lit(2), F.size(x))))))

    return let(values, lambda array: F.when(F.size(array) > 0, by_blocks(array)).otherwise(F.array().cast("array<bigint>")))
