"""Content-encoded request bodies to the bytes that scanners read."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden import fixed_values as fv
from textwarden.functions.regex import series_udf

_RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("content", T.BinaryType())])


def _gunzip(data: bytes, limit: int) -> tuple[str, bytes | None]:
    """All members of a gzip stream, inflated no further than one byte beyond the limit."""
    content = b""
    while data:
        stream = zlib.decompressobj(wbits=31)
        try:
            content += stream.decompress(data, limit + 1 - len(content))
        except zlib.error:
            return "malformed", None
        if len(content) > limit:
            return "too_large", None
        if not stream.eof:
            return "malformed", None
        data = stream.unused_data
    return "ok", content


def decode_bodies(
    df: DataFrame, body: str, encoding: str, max_bytes: int = fv.MAX_BODY_BYTES, out: str = "decoded"
) -> DataFrame:
    """Add struct(status, content, was_decoded): ok, too_large, malformed or unsupported.

    Plain bodies never leave the JVM. Layers are undone right to left; unknown codings and more than three fail.
    """
    kept = df.columns
    layers = F.transform(F.split(F.coalesce(F.col(encoding), F.lit("")), ",", -1), lambda part: F.lower(F.trim(part)))
    blank = F.coalesce(F.trim(F.col(encoding)) == "", F.lit(True))
    known = F.forall(layers, lambda layer: layer.isin("", "identity", "gzip", "x-gzip"))
    n_gzip = F.size(F.filter(layers, lambda layer: layer.isin("gzip", "x-gzip")))
    unsupported = ~blank & ((F.size(layers) > fv.MAX_ENCODING_LAYERS) | ~known)

    @series_udf(_RESULT)
    def inflate(bodies: pd.Series, layer_counts: pd.Series) -> pd.DataFrame:
        rows = []
        for data, count in zip(bodies, layer_counts):
            status, content = "ok", None if data is None else bytes(data)
            for _ in range(0 if content is None else int(count)):
                status, content = _gunzip(content, max_bytes) if content else ("malformed", None)
                if status != "ok":
                    break
            rows.append((status, content))
        return pd.DataFrame(rows, columns=["status", "content"])

    packed = ~blank & ~unsupported & (n_gzip > 0)
    df = df.withColumns({"_packed": packed, "_unsupported": unsupported, "_layers": n_gzip})
    df = df.withColumn("_inflated", inflate(F.when(F.col("_packed"), F.col(body)), F.col("_layers")))
    result = (
        F.when(F.octet_length(body) > max_bytes, F.struct(F.lit("too_large").alias("status"), F.lit(None).cast("binary").alias("content")))
        .when(F.col("_unsupported"), F.struct(F.lit("unsupported").alias("status"), F.lit(None).cast("binary").alias("content")))
        .when(F.col("_packed"), F.struct(F.col("_inflated.status").alias("status"), F.col("_inflated.content").alias("content")))
        .otherwise(F.struct(F.lit("ok").alias("status"), F.col(body).cast("binary").alias("content")))
    )
    df = df.withColumn(out, result)
    was_decoded = F.col("_packed") & (F.col(f"{out}.status") == "ok")
    return df.withColumn(out, F.col(out).withField("was_decoded", was_decoded)).select(*kept, out)
