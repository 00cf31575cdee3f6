"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    The optimiser may inline a projected column into a lambda, which would compute it anew
    for every array element; a lambda variable can not be inlined."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
