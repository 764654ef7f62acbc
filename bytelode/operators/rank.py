"""Rank and access over bits and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bytes import as_bytes, byte_text

#: Rows that a Python task sends at once.
SEND = 500_000
#: Bits of a block, and blocks of a block of blocks.
BLOCK, WIDE = 512, 8192


def _rank_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short texts go out together: a batch for each of them costs more than its rows."""
    for batch in batches:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            join = lambda k: pa.array(np.concatenate([x[k] for x in held]))
            ids = batch.column(0).take(pa.array(np.repeat([x[0] for x in held], [len(x[1]) for x in held])))
            return pa.RecordBatch.from_arrays([ids, join(1), join(2), join(3)], ["id", "idx", "byte", "rank"])

        for row, text in enumerate(batch.column(1)):
            data = np.frombuffer(text.as_py(), np.uint8)
            order = np.argsort(data, kind="stable")
            counts = np.bincount(data, minlength=256)
            rank = np.empty(len(data), np.int64)
            rank[order] = np.arange(len(data)) - np.repeat(np.cumsum(counts) - counts, counts)
            for at in range(0, len(data), SEND):
                part = data[at : at + SEND]
                held.append((row, np.arange(at, at + len(part)), part.astype(np.int32), rank[at : at + SEND]))
                n += len(part)
                if n >= SEND:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()


def byte_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, byte, rank): each byte of each text, and how often it occurs in the text before idx.

    Null and empty texts have no rows. Ranks are taken where the text lies; nothing is shuffled.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), as_bytes(F.col(text_col)).alias("text"))
    kind = texts.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(_rank_batches, f"id {kind}, idx long, byte int, rank long").withColumnRenamed("id", id_col)


def byte_rank(text: Column, byte: int, i: Column | int) -> Column:
    """Occurrences of a byte in a text's bytes before i."""
    head = F.substring(byte_text(text), F.lit(1), (i if isinstance(i, Column) else F.lit(i)).cast("int"))
    return F.regexp_count(head, F.lit(f"\\x{byte:02x}")).cast("long")


def byte_access(text: Column, i: Column | int) -> Column:
    """The byte at i, null beyond the text."""
    at = (i if isinstance(i, Column) else F.lit(i)).cast("int")
    cell = F.hex(F.substring(as_bytes(text), at + 1, F.lit(1)))
    return F.when((at >= 0) & (cell != ""), F.conv(cell, 16, 10).cast("int"))


def _histogram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's texts of one key are counted together: 256 rows a key and batch at most."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        first: dict[str, int] = {}
        for row, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            own = np.bincount(np.frombuffer(text.as_py(), np.uint8), minlength=256)
            name = repr(key)
            if name in sums:
                sums[name] += own
            else:
                sums[name], first[name] = own, row
        rows, held = [], []
        for name, own in sums.items():
            held.append(np.flatnonzero(own))
            rows += [first[name]] * len(held[-1])
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), t)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), join(held, pa.int32()), join([own[b] for own, b in zip(sums.values(), held)], pa.int64())], ["key", "byte", "n"])


def byte_histogram(docs: DataFrame, by: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """(by ..., byte, n): how often each byte occurs; null texts count nothing."""
    key = F.struct(*(F.col(c).alias(f"k{k}") for k, c in enumerate(by or [])), F.lit(0).alias("all"))
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), as_bytes(F.col(text_col)).alias("text"))
    found = texts.mapInArrow(_histogram_batches, f"key {texts.schema['key'].dataType.simpleString()}, byte int, n long")
    return found.groupBy(*(F.col(f"key.k{k}").alias(c) for k, c in enumerate(by or [])), "byte").agg(F.sum("n").alias("n"))


def bit_ranks(bits: DataFrame, idx_col: str = "idx", bit_col: str = "bit", by: list[str] | None = None) -> DataFrame:
    """Adds rank1 and rank0, the ones and zeros before idx, to rows of (by ..., idx, bit).

    Ones are summed by blocks of BLOCK places and by WIDE of these together. Running sums are taken over
    the wide blocks, over blocks within a wide one and over bits within a block, so that of a vector
    with N places no window holds more than N / 4 million, 8192 or 512 rows.
    """
    by = by or []
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    blocked = bits.withColumn("_block", F.floor(F.col(idx_col) / BLOCK))
    ones = F.col(bit_col).cast("int")
    sums = blocked.groupBy(*by, "_block").agg(F.sum(ones).alias("_ones")).withColumn("_wide", F.floor(F.col("_block") / WIDE))
    wide = sums.groupBy(*by, "_wide").agg(F.sum("_ones").alias("_ones")).withColumn("_start", zero(F.sum("_ones").over(before(by, "_wide")))).drop("_ones")
    within = sums.withColumn("_within", zero(F.sum("_ones").over(before([*by, "_wide"], "_block")))).drop("_ones")
    base = within.join(wide, [*by, "_wide"]).select(*by, "_block", (F.col("_start") + F.col("_within")).alias("_base"))
    inside = zero(F.sum(ones).over(before([*by, "_block"], idx_col)))
    ranked = blocked.join(base, [*by, "_block"]).withColumn("rank1", (F.col("_base") + inside).cast("long"))
    return ranked.withColumn("rank0", F.col(idx_col) - F.col("rank1")).drop("_block", "_base")
