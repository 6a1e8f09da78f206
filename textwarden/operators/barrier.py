"""A boundary for expensive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever later filters and projections refer to them.

    Filters move below projections by copying the projected expressions, so a filter on a long chain of columns
    would repeat the chain many times over. A generator of exactly one row keeps the chain below it.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    pinned = df.select("*", F.explode(F.array(packed)).alias("_pin"))
    others = [name for name in df.columns if name not in columns]
    return pinned.select(*others, *[F.col(f"_pin.{name}").alias(name) for name in columns])
