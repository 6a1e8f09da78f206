"""Mixing sources to target weights by pivotal dependent rounding.

Targets: weights share the budget; no source gets more than ``limit`` times its size, the excess is shared out again. A document's
copies are then target / source size: whole copies plus a fraction. Fractions are rounded in pairs: mass moves from one document
to the other, either way with the odds that keep both expectations, until one of them is integral, while the pair's words
stay what they were. So only one fraction is left of any set of documents. Sets are hash groups of one source, of bounded size;
their residuals meet in groups of residuals, level by level, until one is left for each source and is rounded by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.tables import keep, rank_from_zero
from textwarden.llm.wordstream import U, mix

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, LIMIT = 1.5, 2.0
#: Documents of one rounding group on average, and groups whose residuals meet on the next level.
GROUP, FAN_IN = 2048, 512


def n_words(text: str) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n_docs, target) for ``sizes`` (source, size); sources rank by code point, null last."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = rank_from_zero(table, "source", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = keep(ranked.withColumn("weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    rate = 0.0
    while True:  # each turn sends two numbers to the driver and caps at least one more source
        over = ranked.agg(F.sum(F.when(capped, limit * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not over[1]:
            break
        rate = max(0.0, budget * total - (over[0] or 0.0)) / over[1]
        now = F.lit(rate) * F.col("weight") > limit * F.col("source_size")
        if ranked.where(now & ~capped).isEmpty():
            break
        capped = now
    target = F.when(capped, limit * F.col("source_size")).otherwise(F.lit(rate) * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def pivotal(size: np.ndarray, x: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Round the fractions x in turn; sum of size * x is kept, at most one fraction is left. ``luck`` decides each move."""
    x, left = x.astype(float).copy(), -1
    for i in range(len(x)):
        if not 1e-9 < x[i] < 1 - 1e-9:
            x[i] = round(x[i])
            continue
        if left < 0:
            left = i
            continue
        a, b, ratio = x[left], x[i], size[i] / size[left]
        up, down = min(1 - a, b * ratio), min(a, (1 - b) * ratio)  # what the first may gain or lose
        if luck[i] * (up + down) < down:
            a, b = a + up, b - up / ratio
        else:
            a, b = a - down, b + down / ratio
        a, b = (round(v) if not 1e-9 < v < 1 - 1e-9 else v for v in (a, b))
        x[left], x[i] = a, b
        left = left if 0 < a < 1 else i if 0 < b < 1 else -1
    return x


def _round_group(level: int, seed: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "id", "x"], na_position="last", kind="stable", ignore_index=True)
        bits = mix(rows["h"].to_numpy().view(U) ^ mix(np.arange(len(rows), dtype=U) + U(seed * 1_000_003 + level * 7919)))
        rows["x"] = pivotal(rows["size"].to_numpy().astype(float), rows["x"].to_numpy(), (bits >> U(11)).astype(float) / 2.0**53)
        return rows

    return work


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT, seed: int = 0) -> DataFrame:
    """Per document: _id, _hash (of the text), size, source, source_size, target (of the source) and copies (0 to ``limit``).

    Choices hang on ids, texts and ``seed`` alone, so reruns agree however the rows are dealt. Null sources are one source, null
    and empty texts have size 0 and no copies. Repeated rows each get their own copies. Other columns are not looked at. An
    empty table gives an empty result; sources without words get the target 0.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), n_words(text_col).alias("size"), F.col(source_col).alias("source"))
    sizes = keep(base, "sizes")
    targets = keep(source_targets(sizes, weights, budget, limit), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(share)).otherwise(0).cast("int"))
    rows = rows.withColumn("x", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0)).withColumn("h", F.xxhash64(F.lit(seed), "_id", "_hash"))
    rows = rows.withColumn("id", F.col("_id").cast("string")).withColumn("node", F.pmod("h", F.ceil(F.col("n_docs") / GROUP)))
    names = ["_id", "_hash", "size", "source", "source_size", "target", "whole", "x", "h", "id", "node"]
    rows, done, level = rows.select(names), None, 0
    schema = rows.schema
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    nodes = -(-most // GROUP)
    while True:
        rounded = keep(rows.groupBy("source", "node").applyInPandas(_round_group(level, seed), schema), "rounded")
        fraction = F.col("x").between(1e-9, 1 - 1e-9)
        if nodes <= 1:  # one residual for each source: its own odds
            luck = F.shiftrightunsigned(F.xxhash64("h", F.lit(level)), 11) / float(1 << 53)
            last = rounded.withColumn("x", F.when(fraction, (luck < F.col("x")).cast("double")).otherwise(F.col("x")))
            done = last if done is None else done.unionByName(last)
            return done.select("_id", "_hash", "size", "source", "source_size", "target", (F.col("whole") + F.round("x")).cast("int").alias("copies"))
        done = rounded.where(~fraction) if done is None else done.unionByName(rounded.where(~fraction))
        rows = rounded.where(fraction).withColumn("node", F.floor(F.col("node") / FAN_IN))
        nodes, level = -(-nodes // FAN_IN), level + 1


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it was taken, columns as they were."""
    taken = mix_sources(docs, id_col, text_col, source_col, **options).groupBy("_id", "_hash", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    rows = docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(source_col).alias("s"))
    joined = rows.join(taken, F.col("i").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_hash")) & F.col("s").eqNullSafe(F.col("source")))
    # Rows equal in id, text and source share what they were given; the first ones get what is over.
    even, over = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    turn = F.row_number().over(Window.partitionBy("i", "h", "s").orderBy("h"))
    numbered = joined.where(over == 0).withColumn("n", even).unionByName(joined.where(over > 0).withColumn("n", even + (turn <= over).cast("long")))
    spread = numbered.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return spread.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
