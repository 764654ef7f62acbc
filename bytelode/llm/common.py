"""What several operators share: tables, the held-out rule, rows that keep their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, cleared, default_partitions, shared_folder  # noqa: F401

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows a model may learn from: the id is known and not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one column `row` beside `keys`: whatever names the table has, none can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(key.alias(name) for name, key in keys.items()))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, which tells where the nulls are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))
