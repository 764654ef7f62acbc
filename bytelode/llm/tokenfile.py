"""Token ids of a corpus in files of rANS segments, and back.

Documents are range-partitioned by id; each partition is tokenised in id order and written as Parquet
rows of (part, segment, ids of its documents, their lengths, tokens before it in the part, segment
bytes). A segment holds whole documents, about SEGMENT tokens or one longer document, so memory is
bounded by that. Rows decode on their own; the first token of a document follows from the parts' sums.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rans
from .common import Scratch, default_partitions, table

SEGMENT = 1 << 21
#: Words in each of two generations that a worker remembers (about 170 bytes each).
REMEMBERED = 300_000
#: Bytes of texts, and new words, that are encoded together.
TOGETHER, GROUP = 256 << 10, 64
_SEGMENTS = "part int, segment int, doc_ids array<long>, lengths array<long>, before long, n_tokens long, data binary"
#: Pieces that are pre-tokens on their own: Latin letters that lower-case one to one, a digit, and ASCII
#: punctuation without the apostrophe (contractions) and the sign that opens special tokens.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-įı-ſ", r"!-&(-/:;=-@\[-`{-~"
_PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_ODD = re.compile(rf"[^{_LETTERS}0-9{_MARKS}\x20\x09-\x0D]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")


class Encoder:
    """A tokenizer file's ids for whole texts.

    Where the file's words end in a suffix and white space only separates, a text's ids are those of its
    pieces in a row: words, digits and punctuation, or a whole white-space chunk where it holds any other
    character. Each different piece is encoded once while it is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        splits = [s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and r"^\s" in s["pattern"].get("Regex", "")]
        eats = any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        self.by_piece = bool(suffix and splits) and not eats
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if self.by_piece:
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.fold = str.lower if "Lowercase" in re.findall(r'"type": "(\w+)"', json.dumps(spec.get("normalizer"))) else str
            self.words: dict[str, bytes] = {}
            self.aged: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _PIECE.findall(self.fold(text))
        found: list[str] = []
        for chunk in _CHUNK.findall(text):
            found += [chunk] if _ODD.search(chunk) else _PIECE.findall(self.fold(chunk))
        return found

    def _learn(self, pieces: list[str]) -> None:
        """Many pieces are encoded as one text, whose ids are cut where words end."""
        odd = [p for p in pieces if _ODD.search(p)] if _ODD.search(" ".join(pieces)) else []
        plain = [p for p in pieces if not _ODD.search(p)] if odd else pieces
        for at in range(0, len(plain), GROUP):
            group = plain[at : at + GROUP]
            ids = self._raw([" ".join(group)])[0]
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(group):
                odd += group
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            for piece, start, end in zip(group, [0, *ends], ends):
                self.words[piece] = raw[start * size : end * size]
        for piece, ids in zip(odd, self._raw(odd)):
            self.words[piece] = ids.tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_piece:
            return self._raw([t.decode("utf-8", "replace") for t in texts])
        pieces = [self._pieces(t.decode("utf-8", "replace")) for t in texts]
        distinct = set(chain.from_iterable(pieces))
        if len(self.words) + len(distinct) > REMEMBERED:
            self.aged, self.words = self.words, {}
        words, fresh = self.words, []
        for piece in distinct:
            if piece not in words:
                ids = self.aged.get(piece)
                if ids is None:
                    fresh.append(piece)
                else:
                    words[piece] = ids
        self._learn(fresh)
        here = {piece: words[piece] for piece in distinct}  # small enough for a processor's cache
        return [np.frombuffer(b"".join(map(here.__getitem__, found)), self.dtype) for found in pieces]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about TOGETHER bytes of text, or one longer text."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(1)).to_pylist()], np.int64)
    group, start = np.cumsum(sizes) // TOGETHER, 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def _write_segments(path: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            n = sum(lengths)
            row = [part, number, list(doc_ids), list(lengths), before, n, rans.encode(np.concatenate(ids))]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            number, before = number + 1, before + n
            for x in (ids, doc_ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [f.split()[0] for f in _SEGMENTS.split(", ")])

        held = 0
        for batch in batches:
            for few in _slices(batch):
                texts = [t or b"" for t in few.column(1).cast(pa.binary()).to_pylist()]
                for i, got in zip(few.column(0).to_pylist(), encoder(path).encode(texts)):
                    ids += [got.astype(np.uint32), end]
                    doc_ids.append(i)
                    lengths.append(len(got) + 1)
                    held += len(got) + 1
                    if held >= segment_tokens:
                        yield flush()
                        held = 0
        if lengths:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT) -> None:
    """Writes the ids of every whole text, in ascending id order, to the folder `out`."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = own.repartitionByRange(default_partitions(docs.sparkSession), "id", "tie").sortWithinPartitions("id", "tie")
    dealt.select("id", "text").mapInArrow(_write_segments(path, end_id, segment_tokens), _SEGMENTS).write.option("compression", "uncompressed").parquet(out)


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, doc_ids, lengths, before, n_tokens, data in zip(*(c.to_pylist() for c in batch.columns)):
            ids = rans.Segment(data).ids().astype("<u4")
            ends = np.cumsum(lengths)
            if len(ids) != n_tokens or ends[-1] != n_tokens:
                raise rans.Damaged(f"part {part}: its documents' lengths")
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(lengths), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, out: str, id_name: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files in `out`.

    `start` counts the ids of all documents before it, in ascending id order (null first, equal ids by
    their text's hash).
    """
    rows = spark.read.schema(_SEGMENTS).parquet(out)
    # One row for each file; their number is set when writing, not by the documents.
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    starts = sums.select("part", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    docs = rows.mapInArrow(_read_segments, "part int, id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(starts), "part").select(F.col("id").alias(id_name), (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the tokens of `docs` to the shared folder and returns what the files hold.

    Null and empty texts have the end id alone. Repeated rows are written each. An empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    out = f"{Scratch(docs.sparkSession).root}/tokens"
    write_tokens(docs, out, path, end_id)
    return read_tokens(docs.sparkSession, out)


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))


def write_and_read(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every row's ids are written and read back.

    Null and empty texts give the end id alone, repeated rows and ids a row each. An empty table gives none.
    """
    return encode_and_read(docs)
