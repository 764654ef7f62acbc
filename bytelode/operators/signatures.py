"""Contains without reading all texts: signatures of byte trigrams beside a stored table.

Texts are stored in blocks of about `texts` rows, sorted by block, and each block has a Bloom filter of the trigrams in its texts
(A-Z lowered, so both kinds of search can use it), as rows (block, word, bits). A query's trigrams meet these rows by an equi-join; only
blocks whose filter holds all of them are read, by row groups that Parquet leaves out, and searched as usual. Patterns
under three bytes have no trigram and read all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import as_bytes
from ..plans.patterns import FOLD, Patterns, pattern_list
from ..session import default_partitions
from . import search

#: Bits of a block's filter (64 KB), and texts of a block.
BITS, TEXTS = 1 << 19, 1000
#: Bytes of a row group of the stored texts: those of other blocks are left out.
GROUP_BYTES = 1 << 20
_FOLDED = np.frombuffer(FOLD, np.uint8)


def gram_bits(text: bytes) -> np.ndarray:
    """The filter's bits of a text's trigrams, once each."""
    data = _FOLDED[np.frombuffer(text, np.uint8)].astype(np.uint64)
    grams = np.unique(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) if len(data) > 2 else np.zeros(0, np.uint64)
    mixed = grams * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _words(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, its bits) of sorted bits."""
    words, starts = np.unique(bits >> 6, return_index=True)
    ones = np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64))
    return words, (np.bitwise_or.reduceat(ones, starts) if len(words) else np.zeros(0, np.uint64)).view(np.int64)


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, bits): a batch's texts of one block, which follow one another, are put together."""
    for batch in batches:
        own: dict[int, list[np.ndarray]] = {}
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own.setdefault(block, []).append(gram_bits(text.as_py()))
        blocks, words, bits = [], [], []
        for block, held in own.items():
            w, b = _words(np.unique(np.concatenate(held)))
            blocks.append(np.full(len(w), block))
            words.append(w)
            bits.append(b)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([join(blocks), join(words), join(bits)], ["block", "word", "bits"])


class SignedTexts:
    """A stored table of (id, text BINARY, block) with its signatures; it does not change."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id"):
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    def candidates(self, patterns: Patterns) -> DataFrame:
        """(pattern_id, block): the blocks that may hold each pattern of a stated set."""
        wanted = [(i, p) for i, p in pattern_list(patterns) if p is not None and b"\0" not in p]
        asked = []
        for k, (_, p) in enumerate(wanted):
            words, bits = _words(gram_bits(p))
            asked += [(k, int(w), int(b), len(words)) for w, b in zip(words, bits)]
        signatures = self.spark.read.parquet(f"{self.path}/signatures")
        table = self.spark.createDataFrame(asked, "place long, word long, asked long, words long")  # as long as the stated patterns
        met = signatures.join(F.broadcast(table), "word").where(F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked"))
        found = met.groupBy("place", "block").agg(F.count("*").alias("n"), F.first("words").alias("words")).where("n = words").select("place", "block")
        short = [k for k, (_, p) in enumerate(wanted) if len(p) < 3]
        if short:
            every = self.docs().select("block").distinct()
            found = found.union(every.select(F.explode(F.array(*(F.lit(k).cast("long") for k in short))).alias("place"), "block"))
        kind = "long" if all(isinstance(i, int) for i, _ in wanted) else "string"
        names = self.spark.createDataFrame([(k, i) for k, (i, _) in enumerate(wanted)], f"place long, pattern_id {kind}")
        return found.join(F.broadcast(names), "place").select("pattern_id", "block")

    def _near(self, patterns: Patterns) -> DataFrame:
        """The texts of blocks that may hold a pattern; as many numbers as blocks come to the driver, for the scan to leave row groups out."""
        blocks = sorted(r.block for r in self.candidates(patterns).select("block").distinct().collect())
        return self.docs().where(F.col("block").isin(blocks) if blocks else F.lit(False))

    def read_share(self, patterns: Patterns) -> float:
        """The share of all blocks that a query reads."""
        n = self.docs().select("block").distinct().count()
        return self.candidates(patterns).select("block").distinct().count() / n if n else 0.0

    def contains(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        """(id, pattern_id), the rows of a scan over all texts."""
        return search.contains(self._near(patterns), patterns, ci, id_col=self.id_col)

    def count(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        return search.count(self._near(patterns), patterns, ci, id_col=self.id_col)


def sign_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: int = TEXTS) -> SignedTexts:
    """Stores the texts that are not null, by id, with their signatures."""
    spark, known = docs.sparkSession, docs.where(F.col(text_col).isNotNull())
    blocks = max(1, -(-known.count() // texts))
    # A file holds many blocks, so files and tasks grow with the session's partitions, not with the blocks.
    own = known.select(F.col(id_col), as_bytes(F.col(text_col)).alias("text")).repartitionByRange(min(blocks, default_partitions(spark)), id_col).sortWithinPartitions(id_col)
    place = own.withColumn("_at", F.monotonically_increasing_id())  # the partition's number above 33 bits of the row's
    numbered = place.withColumn("block", F.expr(f"shiftleft(shiftright(_at, 33), 33) + (_at & {(1 << 33) - 1}) div {texts}")).drop("_at")
    numbered.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/docs")
    stored = spark.read.parquet(f"{path}/docs").select("block", "text")
    words = stored.mapInArrow(_signature_batches, "block long, word long, bits long")
    words.groupBy("block", "word").agg(F.bit_or("bits").alias("bits")).repartitionByRange("word", "block").sortWithinPartitions("word").write.parquet(f"{path}/signatures")
    return SignedTexts(spark, path, id_col)
