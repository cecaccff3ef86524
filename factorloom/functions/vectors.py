"""Column functions over factor arrays and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two double arrays, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def shuffle_key(user: str, item: str, seed: int) -> Column:
    """A fixed pseudo-random order of (user, item) pairs, the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.col(user).cast("string"), F.col(item).cast("string"), F.lit(str(seed))))


def same_elements(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements, order aside."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def human_size(n: Column) -> Column:
    """A number of bytes in a readable unit, one decimal."""
    units = ["B", "kB", "MB", "GB", "TB", "PB"]
    step = F.least(F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / F.log(F.lit(1024.0))), F.lit(len(units) - 1)).cast("int")
    return F.format_string("%.1f %s", n / F.pow(F.lit(1024.0), step), F.element_at(F.array(*map(F.lit, units)), step + 1))


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """A uniform whole number in [low, high]."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")
