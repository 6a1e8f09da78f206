"""Running state over long ordered sequences without putting one sequence into one task.

A sequence is cut into blocks of bounded length. Windows run inside blocks; the carry into each block comes from one
summary row per block. A sequence that holds most of the data therefore spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 65_536


def with_preceding(
    df: DataFrame, sequence: str, order: str, flag: Column, value: Column, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``n_before`` (flagged rows before this one) and ``last_before`` (value of the latest flagged one).

    ``order`` is a non-negative whole number that grows along the sequence; gaps are allowed.
    """
    df = df.withColumns(
        {
            "_block": F.call_function("div", F.col(order), F.lit(block_rows)),
            "_flag": F.coalesce(flag, F.lit(False)),
            "_value": F.when(flag, value),
        }
    )
    inside = Window.partitionBy(sequence, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "_n_inside": F.coalesce(F.sum(F.col("_flag").cast("bigint")).over(inside), F.lit(0)),
            "_last_inside": F.last("_value", ignorenulls=True).over(inside),
        }
    )
    blocks = df.groupBy(sequence, "_block").agg(
        F.sum(F.col("_flag").cast("bigint")).alias("_n_block"),
        F.max_by("_value", F.when(F.col("_flag"), F.col(order))).alias("_last_block"),
    )
    earlier = Window.partitionBy(sequence).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = blocks.select(
        sequence,
        "_block",
        F.coalesce(F.sum("_n_block").over(earlier), F.lit(0)).alias("_n_carry"),
        F.last("_last_block", ignorenulls=True).over(earlier).alias("_last_carry"),
    )
    joined = df.join(carries, [sequence, "_block"])
    return joined.withColumns(
        {
            "n_before": F.col("_n_carry") + F.col("_n_inside"),
            "last_before": F.coalesce("_last_inside", "_last_carry"),
        }
    ).drop("_block", "_flag", "_value", "_n_inside", "_last_inside", "_n_carry", "_last_carry")
