"""Texts of any length as rows of blocks (id, block, data BINARY): each block but a text's last has `size` bytes.

A text larger than a cell, or one that comes in chunks, is never whole in one task. Searches see the start of the
blocks behind a block by an exchange on (id, block), so a match that spans blocks is found once, by the block it starts in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import as_bytes
from ..operators import search
from ..operators.prefix import sum_before
from ..plans.patterns import Patterns, pattern_list
from ..session import Scratch

BLOCK_BYTES = 1 << 20


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """(id, block, data) of texts in cells; an empty text is one empty block, null texts have none."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))
    last = F.greatest(F.ceil(F.octet_length("text") / size).cast("long") - 1, F.lit(0).cast("long"))
    cut = texts.select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return cut.select("id", "block", F.expr(f"substring(text, cast(block * {size} as int) + 1, {size})").alias("data"))


def join_chunks(chunks: DataFrame, id_col: str = "doc_id", seq_col: str = "seq", chunk_col: str = "chunk", size: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(id, block, data) of texts that come as chunks of any size, in the order of seq (then of the chunks).

    Each chunk's place follows from running sums over range partitions; it is cut where blocks end, and a
    block's pieces, `size` bytes together, meet in one row. Null chunks count as empty; a text of empty chunks is one empty block.
    """
    scratch = scratch or Scratch(chunks.sparkSession)
    data = F.coalesce(as_bytes(F.col(chunk_col)), F.lit(b""))
    rows = chunks.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), data.alias("chunk"), F.xxhash64(data).alias("tie"), F.octet_length(data).cast("long").alias("n"))
    # Equal chunks of one seq can't be told apart: they stand one after the other.
    slim = rows.groupBy("id", "seq", "tie").agg(F.count("*").alias("times"), F.sum("n").alias("n"))
    starts = sum_before(slim, ["id"], ["seq", "tie"], {"start": "n"}, scratch.write).select(F.col("id").alias("_id"), F.col("seq").alias("_seq"), F.col("tie").alias("_tie"), "times", "start")
    once = rows.dropDuplicates(["id", "seq", "tie"])
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("seq").eqNullSafe(F.col("_seq")) & (F.col("tie") == F.col("_tie"))
    repeats = once.join(starts, same).select("id", "chunk", "n", F.col("start").alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("k"))
    placed = repeats.select("id", "chunk", "n", (F.col("first") + F.col("k") * F.col("n")).alias("start"))
    blocks = F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + greatest(n - 1, 0)) div {size}"))).alias("block")
    low = F.greatest(F.col("start"), F.col("block") * size)
    high = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * size)
    pieces = placed.select("*", blocks).withColumn("low", low).withColumn("high", high).select("id", "block", F.col("low").alias("at"), F.expr("substring(chunk, cast(low - start as int) + 1, cast(greatest(high - low, 0) as int))").alias("piece"))
    joined = pieces.groupBy("id", "block").agg(F.expr("listagg(piece, X'') WITHIN GROUP (ORDER BY at, octet_length(piece))").alias("data"))
    # An empty chunk at the end of a full block makes no block of its own.
    return joined.select("id", "block", F.coalesce("data", F.lit(b"")).alias("data")).where("block = 0 or octet_length(data) > 0")


@dataclass
class BlockTexts:
    """Texts in blocks, and the searches over them: the results of the whole texts, offsets of any size."""

    rows: DataFrame  # id, block, data
    size: int = BLOCK_BYTES

    def _ahead(self, patterns: Patterns) -> int:
        """How many bytes behind a block its matches may need."""
        if isinstance(patterns, DataFrame):
            longest = patterns.agg(F.max(F.octet_length(as_bytes(F.col(patterns.columns[1]))))).first()[0]
        else:
            longest = max((len(p) for _, p in pattern_list(patterns)), default=0)
        return max(0, (longest or 0) - 1)

    def with_ahead(self, ahead: int) -> DataFrame:
        """Adds `head`, the `ahead` bytes behind each block, from as many blocks as hold them; null at a text's end."""
        out, steps = self.rows.withColumn("head", F.lit(None).cast("binary")), -(-ahead // self.size)
        for k in range(1, steps + 1):
            need = min(self.size, ahead - (k - 1) * self.size)
            behind = self.rows.select(F.col("id").alias("_id"), (F.col("block") - k).alias("_block"), F.substring("data", 1, need).alias("_head")).where("_block >= 0")
            met = out.join(behind, F.col("id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block")), "left")
            out = met.select("id", "block", "data", F.when(F.col("_head").isNull(), F.col("head")).otherwise(F.concat(F.coalesce("head", F.lit(b"")), F.col("_head"))).alias("head"))
        return out

    def _texts(self, patterns: Patterns) -> DataFrame:
        return self.with_ahead(self._ahead(patterns)).select(F.struct("id", "block").alias("key"), F.concat("data", F.coalesce("head", F.lit(b""))).alias("text"), "head")

    def lengths(self) -> DataFrame:
        return self.rows.groupBy("id").agg(F.sum(F.octet_length("data")).cast("long").alias("text_len"))

    def count(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        """(id, pattern_id, n_matches): of a block with its head, less those within the head, which the next blocks count."""
        found = self._texts(patterns)
        both = found.select(F.struct("key.id", F.lit(1).alias("sign")).alias("key"), "text").union(found.where("head is not null").select(F.struct("key.id", F.lit(-1).alias("sign")).alias("key"), "head"))
        counted = search.count(both, patterns, ci, "key")
        return counted.groupBy(F.col("key.id").alias("id"), "pattern_id").agg(F.sum(F.col("key.sign") * F.col("n_matches")).alias("n_matches")).where("n_matches > 0")

    def contains(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        """(id, pattern_id)."""
        return search.contains(self._texts(patterns), patterns, ci, id_col="key").select("key.id", "pattern_id").distinct()

    def locate(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        """(id, pattern_id, pos), pos from the start of the whole text."""
        texts = self._texts(patterns).select(F.struct("key.id", "key.block", (F.octet_length("text") - F.coalesce(F.octet_length("head"), F.lit(0))).alias("own"), F.col("head").isNull().alias("last")).alias("key"), "text")
        found = search.locate(texts, patterns, ci, "key")
        # An empty pattern also stands at the end of the text, not of every block.
        mine = F.col("pos") < F.col("key.own")
        return found.where(mine | (F.col("key.last") & (F.col("pos") == F.col("key.own")))).select("key.id", "pattern_id", (F.col("key.block") * self.size + F.col("pos")).alias("pos"))

