"""Scans for patterns that are a table: Rabin-Karp windows that meet the table by an equi-join.

Each pattern is anchored by its longest start of 1, 2, 4 ... 64 bytes. One read of a text makes the rolling hashes of its
windows of those lengths, all at once by doubling; a Bloom filter of the anchors' hashes leaves the few windows that may
start a pattern, and these, with the bytes behind them, meet the table by hash and are held against the patterns. The table itself
never reaches the driver, only the filter's bits do (FILTER_BITS at most) and a row for each anchor length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import as_bytes
from ..plans.patterns import FOLD, pattern_table
from ..session import Scratch

#: The longest anchor, and the bytes that a window carries at most. Longer patterns are held against the text.
LONGEST, CARRIED = 64, 128
#: Bits of the filter for each pattern, and bits at most (16 MB): beyond that more windows reach the join.
BITS_EACH, FILTER_BITS = 16, 1 << 27
#: A table of so many patterns is broadcast to the windows; more are shuffled with them.
BROADCAST_ROWS = 50_000
#: Bytes of a text whose windows are hashed at once, and rows that a task sends at once.
PIECE, SEND = 1 << 20, 200_000
#: Bytes of short texts that are hashed together, and windows whose bytes are taken at once.
TOGETHER, CELLS = 1 << 16, 1 << 14

_BASE = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1


def window_hashes(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """The hash of the window of each size (powers of two, 0 for the empty one) at each place where it fits.

    The polynomial of a window of 2k bytes follows from those of its halves.
    """
    out, now, k, power = {}, data.astype(np.uint64) + np.uint64(1), 1, _BASE
    if 0 in sizes:
        out[0] = np.zeros(len(data) + 1, np.uint64)
    while True:
        if k in sizes:
            out[k] = now
        k *= 2
        if k > max(sizes, default=0) or len(data) < k:
            break
        now = now[: -(k // 2)] * np.uint64(power) + now[k // 2 :]
        power = power * power & _U64
    for size, h in out.items():
        h = (h ^ (h >> np.uint64(31))) * np.uint64((0xBF58476D1CE4E5B9 + 2 * size) & _U64)
        out[size] = h ^ (h >> np.uint64(29))
    return out


def anchor(size: Column) -> Column:
    """The anchor's length of a pattern's: the greatest power of two, LONGEST at most; 0 for an empty pattern."""
    found = F.lit(0)
    for k in range(LONGEST.bit_length()):
        found = F.when(size >= 1 << k, 1 << k).otherwise(found)
    return found


def _anchor_hash(patterns: pa.Array, anchors: pa.Array) -> pa.Array:
    out = [window_hashes(np.frombuffer(p[:a], np.uint8), [a])[a][0] for p, a in zip(patterns.to_pylist(), anchors.to_pylist())]
    return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) * np.uint64(0x2545F491) & mask


@dataclass
class PatternTable:
    """Patterns (pattern_id, pattern, anchor, hash), written once; what the scans must know of them."""

    rows: DataFrame
    longest: dict[int, int]  # by anchor length
    count: int
    bits: int
    filter: Broadcast

    @property
    def sized(self) -> DataFrame:
        return F.broadcast(self.rows) if self.count <= BROADCAST_ROWS else self.rows


def prepare(patterns: DataFrame, ci: bool = False, scratch: Scratch | None = None) -> PatternTable:
    """From (id, pattern) rows; null patterns and those with a zero byte match nothing and are left out."""
    spark = patterns.sparkSession
    scratch = scratch or Scratch(spark)
    own = pattern_table(spark, patterns, ci).where(F.expr("not contains(pattern, X'00')")).withColumn("anchor", anchor(F.octet_length("pattern")))
    rows = scratch.write(own.withColumn("hash", F.arrow_udf(_anchor_hash, "long")("pattern", "anchor")))
    sizes = rows.groupBy("anchor").agg(F.max(F.octet_length("pattern")).alias("most"), F.count("*").alias("n")).collect()  # nine rows at most
    count = sum(r.n for r in sizes)
    bits = min(FILTER_BITS, max(1 << 10, 1 << (BITS_EACH * count).bit_length()))
    mask = F.lit(bits - 1)
    second = F.shiftrightunsigned("hash", 32) * F.lit(0x2545F491)
    places = F.explode(F.array(F.col("hash").bitwiseAND(mask), second.bitwiseAND(mask))).alias("at")
    # As many rows as the filter has words: 2 million at most.
    words = rows.where("anchor > 0").select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return PatternTable(rows, {r.anchor: r.most for r in sizes}, count, bits, spark.sparkContext.broadcast(held.view(np.uint64)))


def _carried(data: np.ndarray, at: np.ndarray, size: int, ends: np.ndarray | None = None) -> np.ndarray:
    """The `size` bytes from each place on, zeros behind the end (of the data, or `ends`): no pattern holds a zero."""
    cells = at[:, None] + np.arange(size)
    inside = cells < (len(data) if ends is None else ends[:, None])
    return np.where(inside, data[np.minimum(cells, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)


def _pack(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, max(size, 1), np.int32)[: n + 1] if size else np.zeros(n + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _window_batches(longest: dict[int, int], bits: int, sent: Broadcast, places: bool, ci: bool):
    """Rows (key, text) come in; (key, hash, bytes, value) of windows that may start a pattern go out: value is the
    window's place or, without places, how often these bytes stand in the piece of the text."""
    sizes = sorted(longest)
    behind = max([min(CARRIED, m) for m in longest.values()], default=0)

    def may_start(h: np.ndarray) -> np.ndarray:
        first, second = _places(h, bits)
        bit = lambda p: sent.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)
        return np.flatnonzero(bit(first) & bit(second))

    def found(data: np.ndarray, starts: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, hash, bytes, value) of texts that lie one after the other, so short ones are hashed together: text k begins at
        starts[k], and its first own[k] windows are asked for."""
        ends = np.append(starts[1:], len(data))
        text_of = np.repeat(np.arange(len(starts)), ends - starts)
        for size, h in window_hashes(data, sizes).items():
            if not size and not places:
                yield np.flatnonzero(own), np.zeros(np.count_nonzero(own), np.uint64), np.zeros((np.count_nonzero(own), 0), np.uint8), own[own > 0]
                continue
            if size:
                at = may_start(h)
                of = text_of[at]
                fits = (at + size <= ends[of]) & (at - starts[of] < own[of])
                at, of = at[fits], of[fits]
            else:
                of = np.repeat(np.arange(len(starts)), own)
                at = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own) + starts[of]
            for k in range(0, len(at), CELLS):
                where, which = at[k : k + CELLS], of[k : k + CELLS]
                hashes = h[where] if size else np.zeros(len(where), np.uint64)
                cells = _carried(data, where, min(CARRIED, longest[size]), ends[which])
                if places:
                    yield which, hashes, cells, where - starts[which]
                else:
                    told = np.concatenate((which.astype(np.uint32)[:, None].view(np.uint8), cells), 1)
                    _, first, n = np.unique(told.view(f"V{told.shape[1]}").ravel(), return_index=True, return_counts=True)
                    yield which[first], hashes[first], cells[first], n

    def groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, offset, data, starts, own) of a text's piece, or of whole texts of a piece's bytes together."""
        near: list[bytes] = []

        def together(row: int):
            lengths = np.array([len(t) for t in near])
            return row - len(near), 0, np.frombuffer(b"".join(near), np.uint8), np.cumsum(lengths) - lengths, lengths + 1  # the empty pattern also stands at the end

        held = 0
        for row, cell in enumerate(texts):
            text = cell.as_py()
            text = text.translate(FOLD) if ci else text
            if near and held + len(text) > TOGETHER:
                yield together(row)
                near, held = [], 0
            if len(text) <= TOGETHER:
                near.append(text)
                held += len(text)
                continue
            whole = np.frombuffer(text, np.uint8)
            for start in range(0, len(text) + 1, PIECE):
                own = min(PIECE, len(text) - start + (start + PIECE > len(text)))
                yield row, start, whole[start : start + PIECE + behind], np.zeros(1, np.int64), np.array([own])
        if near:
            yield together(len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            n = 0

            def send() -> pa.RecordBatch:
                join = lambda k, kind: np.concatenate([x[k] for x in held]).astype(kind) if held else np.zeros(0, kind)
                cells = pa.concat_arrays([_pack(x[2]) for x in held]) if held else pa.array([], pa.binary())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(join(0, np.int64))), pa.array(join(1, np.uint64).view(np.int64)), cells, pa.array(join(3, np.int64))], ["key", "hash", "bytes", "value"])

            for row, offset, data, starts, own in groups(batch.column(1)):
                for of, h, cells, values in found(data, starts, own):
                    held.append((row + of, h, cells, values + offset if places else values))
                    n += len(h)
                    if n > SEND:
                        yield send()
                        held, n = [], 0
            yield send()

    return run


def _windows(texts: DataFrame, table: PatternTable, places: bool, ci: bool) -> DataFrame:
    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(_window_batches(table.longest, table.bits, table.filter, places, ci), f"key {kind}, hash long, bytes binary, value long")


def _met(windows: DataFrame, table: PatternTable) -> DataFrame:
    """Windows whose bytes start as a pattern does, with it; a pattern longer than what they carry is not yet sure."""
    starts = F.expr(f"startswith(bytes, substring(pattern, 1, {CARRIED}))")
    return windows.join(table.sized, "hash").where(starts)


def occurrences(texts: DataFrame, table: PatternTable, places: bool, ci: bool = False, by: list[str] | None = None) -> DataFrame:
    """(key, pattern_id, value) of texts (key, text BINARY): a row for each place, or without places counts to be summed.

    With `by`, fields of the key, counts are summed for these before they meet the table.
    """
    long = table.longest.get(LONGEST, 0) > CARRIED
    windows = _windows(texts, table, places, ci)
    if by is not None:
        windows = windows.groupBy(F.struct(*(F.col(f"key.{c}").alias(c) for c in by)).alias("key") if by else F.lit(0).alias("key"), "hash", "bytes").agg(F.sum("value").alias("value"))
    sure = _met(windows, table).where(F.octet_length("pattern") <= CARRIED).select("key", "pattern_id", "value") if long else _met(windows, table).select("key", "pattern_id", "value")
    if not long:
        return sure
    # Patterns longer than a window carries: their places are held against the texts, told by two hashes of them.
    told = F.struct(F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    named = texts.select(F.struct(F.col("key").alias("own"), told.alias("told")).alias("key"), "text")
    asked = PatternTable(table.rows.where(F.octet_length("pattern") > CARRIED), {LONGEST: table.longest[LONGEST]}, table.count, table.bits, table.filter)
    near = _met(_windows(named, asked, True, ci), asked).select("key.own", "key.told", "pattern_id", "pattern", F.col("value").alias("at"))
    whole = texts.select(told.alias("told"), "text").groupBy("told").agg(F.first("text").alias("text"))
    text = F.expr("substring(text, cast(at as int) + 1, octet_length(pattern))")
    if ci:
        text = F.encode(F.translate(F.decode(text, "ISO-8859-1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "ISO-8859-1")
    held = near.join(whole, "told").where(text == F.col("pattern"))
    key = F.col("own") if by is None else F.struct(*(F.col(f"own.{c}").alias(c) for c in by)) if by else F.lit(0)
    return sure.union(held.select(key.alias("key"), "pattern_id", F.col("at") if places else F.lit(1).cast("long")))


def texts_of(docs: DataFrame, key: Column, text_col: str) -> DataFrame:
    """(key, text BINARY) of the texts that are not null."""
    return docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), as_bytes(F.col(text_col)).alias("text"))
