"""Naming an intermediate value inside a column expression, and rows from a computed array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value) with value computed once, where plain nesting would repeat its whole expression at each use."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def exploded(rows: DataFrame, kept: list[str], elements: Column, name: str = "x", position: str | None = None) -> DataFrame:
    """kept columns of rows with each element (none is null) of an array as name, and its place as position.

    Of a plain explode Spark infers a filter on the array's size and pushes it below the projections that the array is made in. There each named
    value is written out at every use, and inside a lambda it is computed once an element. The outer form has no such filter.
    """
    made = F.posexplode_outer(elements).alias(position, name) if position else F.explode_outer(elements).alias(name)
    return rows.select(*kept, made).filter(F.col(name).isNotNull())
