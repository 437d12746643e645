"""Computing a value once: inside an expression, and across plan nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda is otherwise computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read instead of computing them again.

    A filter on a plain computed column is moved below the projection and takes
    the whole expression along, so a costly one (a parse) runs again for every
    such filter. It does not move below a generator.
    """
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(struct)).alias(*columns))
