"""A growing corpus: appended chunks become visible, as whole texts, at the next rebuild.

Chunks are rows (id, seq, chunk) of an append log, by buckets of ids. A rebuild writes the texts of those buckets anew that
have chunks the last snapshot has not seen (copy on write); the snapshot is a manifest of which version wrote each
bucket, written last, so a rebuild that fails changes nothing and older snapshots can still be read. Queries read
the last snapshot, in which matches span chunks, and give nothing before the first one. A stream appends by
micro-batch; a batch that is written again after a failure replaces itself. One writer rebuilds at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.bytes import as_bytes
from ..operators import search
from ..operators.index import SuffixIndex, build_index
from ..plans.patterns import FOLD, Patterns, pattern_list
from ..session import Files

_LOG = "id long, seq long, chunk binary, batch string, bucket int"
_MANIFEST = "bucket int, written_by int, batch string"
#: Buckets of ids: a rebuild writes those with new chunks.
BUCKETS = 256


_FOUND = "doc_id long, pattern_id long, pos long"
#: Of a text: the bytes seen so far, their last ones that a match may begin in, and the last seq.
_STATE = "size long, tail binary, seq long"


def matches(chunks: DataFrame, patterns: Patterns, ci: bool = False, id_col: str = "doc_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(doc_id, pattern_id, pos) of a stream of chunks: each match once, in the batch in which its last byte comes.

    The state of a text is its size and its last bytes, as many as the longest pattern has less one, so matches span
    appends whatever their number, and no text is read again. Patterns are a stated set with integer ids. Chunks of a text
    must come in the order of seq; one that does not stops the stream. Null chunks count as empty, rows without an id are
    left out. An empty pattern stands at each place that has come, and at 0 with the first chunk.
    """
    wanted = [(i, p) for i, p in pattern_list(patterns, ci) if b"\0" not in p]
    behind = max((len(p) for _, p in wanted), default=1) - 1
    key, sent = search._sent(chunks.sparkSession, wanted)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        size, tail, last = state.get if state.exists else (0, b"", None)
        first, automaton = not state.exists, search._automaton_of(key, sent)
        empty = [i for i, p in sent.value if not p]
        rows = sorted((seq, bytes(chunk)) for frame in frames for seq, chunk in zip(frame["seq"].tolist(), frame["chunk"]))
        if last is not None and rows and rows[0][0] <= last:
            raise ValueError(f"text {group[0]}: chunk {rows[0][0]} comes after chunk {last}")
        new = b"".join(chunk for _, chunk in rows)
        new = new.translate(FOLD) if ci else new
        seen = bytes(tail) + new
        start = size - len(tail)
        out = [(i, start + end + 1 - n) for end, (n, of) in automaton.iter(seen.decode("latin-1")) if end >= len(tail) for i in of] if len(automaton) else []
        out += [(i, place) for i in empty for place in range(size + (not first), size + len(new) + 1)]
        state.update((size + len(new), seen[max(0, len(seen) - behind) :] if behind > 0 else b"", rows[-1][0] if rows else last))
        yield pd.DataFrame({"doc_id": [group[0]] * len(out), "pattern_id": [i for i, _ in out], "pos": [p for _, p in out]}, dtype="int64")

    named = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(seq_col).cast("long").alias("seq"), F.coalesce(as_bytes(F.col(chunk_col)), F.lit(b"")).alias("chunk"))
    return named.groupBy("doc_id").applyInPandasWithState(run, _FOUND, _STATE, "append", GroupStateTimeout.NoTimeout)


class IncrementalCorpus:
    def __init__(self, spark: SparkSession, path: str, sample_step: int = 4, buckets: int = BUCKETS):
        """`buckets` must stay what it was when the corpus was begun."""
        self.spark, self.path, self.sample_step, self.buckets = spark, path.rstrip("/"), max(1, sample_step), buckets

    def _files(self) -> Files:
        return Files(self.spark, self.path)

    def _versions(self) -> list[int]:
        files = self._files()
        return sorted(int(n.split("=")[1]) for n in files.names("snapshots") if files.exists(f"snapshots/{n}/_SUCCESS"))

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log") if self._files().exists("log") else self.spark.createDataFrame([], _LOG)

    def append(self, chunks: DataFrame, id_col: str = "doc_id", seq_col: str = "seq", chunk_col: str = "chunk", batch: str | None = None) -> None:
        """Adds chunks; the order of a text's chunks is that of their seq."""
        rows = chunks.select(F.col(id_col).cast("long").alias("id"), F.col(seq_col).cast("long").alias("seq"), as_bytes(F.col(chunk_col)).alias("chunk"))
        own = rows.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(self.buckets)), F.lit(0)).cast("int"))
        own.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch or uuid.uuid4().hex}")

    def append_stream(self, chunks: DataFrame, checkpoint: str, **columns: str) -> StreamingQuery:
        """Appends what is there of a stream and ends; run it again for what has come since.

        A stream is known by a name that lies in its checkpoint folder, so batches of other streams are
        never overwritten. With a new checkpoint folder it is a new stream, and all it reads is appended.
        """
        named = Files(self.spark, checkpoint)
        names = [n for n in named.names() if n.startswith("appends-")]
        if not names:
            names = [f"appends-{uuid.uuid4().hex}"]
            named.touch(names[0])
        stream = min(names)
        writer = chunks.writeStream.foreachBatch(lambda df, epoch: self.append(df, batch=f"{stream}-{epoch}", **columns))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _joined(self, log: DataFrame) -> DataFrame:
        text = F.expr("listagg(chunk, X'') WITHIN GROUP (ORDER BY seq, chunk)")
        return log.groupBy("bucket", "id").agg(F.coalesce(text, F.lit(b"")).alias("text")).select(F.col("id").alias("doc_id"), "text", "bucket")

    def texts(self) -> DataFrame:
        """(doc_id, text) of all chunks so far, built or not; of equal seq the lesser chunk comes first."""
        return self._joined(self._log()).select("doc_id", "text")

    def _manifest(self, version: int) -> tuple[dict[int, int], set[str]]:
        """Which version wrote each bucket, and the batches that are seen: a row for each bucket and for each append."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/snapshots/version={version}").collect()
        return {r.bucket: r.written_by for r in rows if r.bucket is not None}, {r.batch for r in rows if r.batch is not None}

    def rebuild(self) -> int:
        """Writes the next snapshot and returns its version: only the texts of buckets with new chunks are written."""
        versions = self._versions()
        version = max(versions, default=0) + 1
        written, seen = self._manifest(versions[-1]) if versions else ({}, set())
        there = {n.split("=", 1)[1] for n in self._files().names("log")}
        log = self._log()
        if there - seen:
            fresh = log.where(F.col("batch").isin(sorted(there - seen)))
            touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # as many as buckets
            # Batches that have come since the list was made wait for the next rebuild.
            texts = self._joined(log.where(F.col("bucket").isin(touched) & F.col("batch").isin(sorted(there))))
            texts.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/texts/version={version}")
            written = written | dict.fromkeys(touched, version)
        rows = [(b, w, None) for b, w in sorted(written.items())] + [(None, None, batch) for batch in sorted(there)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/version={version}")
        return version

    def is_built(self) -> bool:
        return bool(self._versions())

    def buffer_len(self) -> int:
        """Bytes of all chunks, those after the last rebuild too."""
        return self._log().agg(F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0)).alias("n")).first()["n"]

    def clear(self) -> None:
        self._files().delete()

    def snapshot(self, version: int | None = None) -> DataFrame:
        """(doc_id, text) of the last snapshot, or of an older one."""
        versions, schema = self._versions(), "doc_id long, text binary"
        if version is None and not versions:
            return self.spark.createDataFrame([], schema)
        written, _ = self._manifest(versions[-1] if version is None else version)
        paths = [f"{self.path}/texts/version={w}/bucket={b}" for b, w in sorted(written.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def search_stream(self, chunks: DataFrame, patterns: Patterns, checkpoint: str, ci: bool = False, **columns: str) -> StreamingQuery:
        """Writes the matches of a stream of chunks beside the corpus as they come (see `matches`); `found` reads them.

        A batch that runs again after a failure replaces itself, so no match is written twice.
        """
        out = f"{self.path}/found"
        writer = matches(chunks, patterns, ci, **columns).writeStream.outputMode("append")
        writer = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/batch={epoch}"))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def found(self) -> DataFrame:
        """(doc_id, pattern_id, pos) of all matches that a stream has found so far."""
        schema = "doc_id long, pattern_id long, pos long, batch long"
        there = self.spark.read.schema(schema).parquet(f"{self.path}/found") if self._files().exists("found") else self.spark.createDataFrame([], schema)
        return there.drop("batch")

    def index(self, path: str) -> SuffixIndex:
        return build_index(self.snapshot(), path, self.sample_step)

    def count(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        return search.count(self.snapshot(), patterns, ci)

    def contains(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        return search.contains(self.snapshot(), patterns, ci)

    def locate(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        return search.locate(self.snapshot(), patterns, ci)

    def locate_all(self, patterns: Patterns, ci: bool = False) -> DataFrame:
        return search.locate_all(self.snapshot(), patterns, ci)
