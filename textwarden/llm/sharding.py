"""Shards of near equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a 64-bit key: 40 bits of the text's hash, so that equal texts are neighbours, then 24 bits of the id's, so that even a
third of all rows with one text can be cut anywhere. Splitters are found by counting exact bytes between probe keys: 4,096 probes over
the whole range, then 4,096 inside each interval that a splitter must lie in, until the interval's bytes are within the
tolerance. Only these counts reach the driver. Then the rows are exchanged once, and numbered inside ranges whose
counts are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.tables import keep

SHARDS = 24
#: Share of a shard's bytes by which a splitter may miss.
TOLERANCE = 0.001
_STEPS = (52, 40, 28, 16, 4, 0)
#: Ranges of equal rank that are numbered apart: top bits of the key, and more of them where a range is crowded.
_RANGE, _CROWDED = 52, 16


def order_key(id_col: str, text_col: str) -> Column:
    low = F.lit((1 << 24) - 1)
    return F.xxhash64(text_col).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.xxhash64(id_col).bitwiseAND(low))


def text_bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8


def splitters(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """(lower ends of shards 1, 2..., crowded ranges) of ``keyed`` (key, size)."""
    counts = keyed.groupBy(F.shiftright("key", _STEPS[0]).alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    total, rows = sum(r["bytes"] for r in counts), sum(r["n"] for r in counts)
    crowded = sorted(r["p"] for r in counts if r["n"] > 8 * rows / 4096 + 64)
    goals = [total * k / shards for k in range(1, shards)]
    found: dict[int, int] = {}
    #: Goal -> (probe interval, bytes below it); at first the whole range of keys.
    inside: dict[int, tuple[int, int]] = {}
    held = {None: sorted((r["p"], r["bytes"]) for r in counts)}
    for level, step in enumerate(_STEPS):
        if level:
            wanted = sorted({p for p, _ in inside.values()})
            if not wanted:
                break
            up = F.shiftright("key", _STEPS[level - 1])
            held = {}
            for r in keyed.where(up.isin(wanted)).groupBy(up.alias("up"), F.shiftright("key", step).alias("p")).agg(F.sum("size").alias("bytes")).collect():
                held.setdefault(r["up"], []).append((r["p"], r["bytes"]))
        for k, goal in enumerate(goals):
            if k in found or level and k not in inside:
                continue
            below = inside[k][1] if level else 0
            for p, size in sorted(held.get(inside[k][0] if level else None, [])):
                if below + size >= goal:
                    if size <= tolerance * total / shards or step == 0:
                        found[k] = (p if goal - below < below + size - goal else p + 1) << step
                        inside.pop(k, None)
                    else:
                        inside[k] = p, below
                    break
                below += size
    top = (1 << 63) - 1
    return [min(found.get(k, top), top) for k in range(shards - 1)], crowded


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, key: Column | None = None, size: Column | None = None) -> DataFrame:
    """``docs`` with shard (int) and slot (long, from 0 without gaps in each shard, in key order). Law: near equal bytes.

    A row weighs its text's UTF-8 bytes plus 8, a null text 8. Nulls and repeated rows are fine: rows equal in id and text have one key,
    and stand side by side in one shard. A table of fewer rows than shards leaves shards empty; an empty one gives none.
    Columns named shard or slot are replaced, others may have any name.
    """
    docs = docs.drop("shard", "slot")
    key = order_key(id_col, text_col) if key is None else key
    size = text_bytes(text_col) if size is None else size
    probes = keep(docs.select(key.alias("key"), size.alias("size")), "shard-keys")
    ends, crowded = splitters(probes, shards, tolerance)
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    shard = sum((F.when(F.col("key") >= F.lit(e), 1).otherwise(0) for e in ends), F.lit(0))
    coarse = F.shiftright("key", _RANGE)
    of = lambda bits: F.shiftleft(F.shiftright("key", bits), bits)
    part = F.when(coarse.isin(crowded), of(_CROWDED)).otherwise(of(_RANGE)) if crowded else of(_RANGE)
    place = [shard.cast("int").alias("shard"), part.alias("part")]
    counts = probes.select(*place).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", F.col(f"row.{id_col}")))
    numbered = rows.select("row", "key", *place).withColumn("inside", inside)
    return numbered.join(offsets, ["shard", "part"]).select("row.*", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Files of the shards, one folder for each, rows in slot order in every file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
