"""Tables of texts, and compressed texts."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import as_bytes


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def compressed(text: Column, level: int = 6) -> Column:
    """A text's bytes, deflated; null stays null."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else zlib.compress(t.as_py(), level) for t in texts], pa.binary())

    return of(as_bytes(text))


def decompressed(data: Column) -> Column:
    """A struct of the text's bytes and, where the data is malformed, an error instead."""

    @F.arrow_udf("text binary, error string")
    def of(column: pa.Array) -> pa.Array:
        texts, errors = [], []
        for d in column:
            text = error = None
            try:
                text = None if d.as_py() is None else zlib.decompress(d.as_py())
            except zlib.error as e:
                error = str(e)
            texts.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()), pa.array(errors, pa.string())], ["text", "error"])

    return of(data)


def compress_text(docs: DataFrame, text_col: str = "text", data_col: str = "data") -> DataFrame:
    """Adds the compressed text."""
    return docs.withColumn(data_col, compressed(F.col(text_col)))


def from_compressed(docs: DataFrame, data_col: str = "data", text_col: str = "text", strict: bool = True) -> DataFrame:
    """The rows with `text_col` (BINARY) for `data_col`. Malformed data fails the job, or with strict off
    gives a null text and its reason in `error`."""
    out = docs.withColumn("_d", decompressed(F.col(data_col))).drop(data_col)
    text = F.col("_d.text")
    if strict:
        text = F.when(F.col("_d.error").isNotNull(), F.raise_error(F.col("_d.error")).cast("binary")).otherwise(text)
    out = out.withColumn(text_col, text)
    return out.drop("_d") if strict else out.withColumn("error", F.col("_d.error")).drop("_d")
