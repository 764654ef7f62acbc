"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits over hashed word shingles. Two fingerprints link at `TAU` or fewer
differing bits. The 64 bits form a ring of M segments. If the differences of all M segments sum to TAU
at most, some start on the ring has every chain of l segments from it differing in l * TAU / M bits at
most (Qin and Xiao 2018). With M = 5 and TAU = 4 the first segment of that chain is equal and the first
two differ in one bit at most, so one half of the second is equal too: (start, first segment, which
half, that half) is a key of about 19 bits on which fingerprints meet. Longer chains prune what met
before the full Hamming check. Equal fingerprints count as one row throughout.

A bucket emits the edges of a spanning forest, never its pairs: linear in its rows. Buckets above
`BLOCK` rows are cut into blocks and each pair of blocks is a task group of its own, which finds the
same links. Random fingerprints meet in N / 2^19 rows per key; for far more than 10^9 distinct texts
raise M with the keys (the chain test stays).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, table
from .components import connected_components

SEED = 42
SHINGLE = 4
TAU = 4
#: Bits of the ring's segments, from the lowest.
SEGMENTS = (13, 13, 13, 13, 12)
#: Rows of a bucket that one task compares at once.
BLOCK = 8192
#: Buckets up to this size list their links directly.
SMALL = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes | None, shingle: int) -> bytes:
    """The XXH64 of each shingle, eight bytes each, the highest first; nothing for null text or no word."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return b""
    joined, count = b" ".join(words), max(1, len(words) - shingle + 1)
    if count == 1:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: count - 1] + 1)).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())])


def _majority(hashed: bytes) -> bytes:
    """Of 64-bit hashes the bits that over half of them have."""
    columns = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return np.packbits(2 * set_bits > len(columns)).tobytes()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number; zero for null text or no word."""
    hashed = shingle_hashes(text, shingle)
    return int.from_bytes(_majority(hashed), "big") if hashed else 0


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): the fingerprint as a signed long. Null and wordless texts have zero."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(_fingerprint_batches(shingle), "id long, text_hash long, fp long")


def _ring() -> tuple[list[int], np.ndarray]:
    """Offsets of the segments, and for each start the masks of its chains of 1 to M segments."""
    offsets = [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]
    alone = [((1 << n) - 1) << at for n, at in zip(SEGMENTS, offsets)]
    masks = np.zeros((len(SEGMENTS), len(SEGMENTS)), np.uint64)
    for start in range(len(SEGMENTS)):
        chain = 0
        for length in range(len(SEGMENTS)):
            chain |= alone[(start + length) % len(SEGMENTS)]
            masks[start, length] = chain
    return offsets, masks


OFFSETS, CHAINS = _ring()
BUDGETS = [length * TAU // len(SEGMENTS) for length in range(1, len(SEGMENTS) + 1)]


def _chain_keys(fp: Column) -> Column:
    """Two keys for each start: its segment, and a half of the next one."""
    part = lambda at, n: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))
    keys = []
    for start, size in enumerate(SEGMENTS):
        after = (start + 1) % len(SEGMENTS)
        low = SEGMENTS[after] // 2
        for half, (at, n) in enumerate(((OFFSETS[after], low), (OFFSETS[after] + low, SEGMENTS[after] - low))):
            keys.append(F.lit((2 * start + half) << 32) + F.shiftleft(part(OFFSETS[start], size), 8) + part(at, n))
    return F.array(*keys)


def _pairs_of_small(keys: np.ndarray, fps: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for step in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (size_of[step:] <= SMALL))
        if not len(at):
            break
        differ, start = fps[at] ^ fps[at + step], (keys[at] >> 33).astype(np.int64)
        for length in range(1, len(SEGMENTS)):
            ok = np.bitwise_count(differ & CHAINS[start, length]) <= BUDGETS[length]
            at, differ, start = at[ok], differ[ok], start[ok]
        ok = np.bitwise_count(differ) <= TAU
        found.append((fps[at[ok]], fps[at[ok] + step]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 2


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links within one bucket."""
    left, a, b = np.unique(fps), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            top = queue.pop()
            near = np.bitwise_count(left ^ top) <= TAU
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), top))
                b.append(got)
                queue.extend(got)
    return a, b


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, block) come in; links go out. A bucket may span batches."""
    kept: tuple[np.ndarray, ...] | None = None

    def links(keys: np.ndarray, block: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(block) != 0)) + 1
        bounds = np.concatenate(([0], cuts, [len(keys)]))
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = sizes[group] <= SMALL
        a, b = [], []
        if few.any():
            # groups take the place of keys for the shifts; the start is read from the key
            x, y = _pairs_of_small(keys[few], fps[few], sizes[group][few])
            a.append(x)
            b.append(y)
        for g in np.flatnonzero(sizes > SMALL):
            x, y = _forest(fps[bounds[g] : bounds[g + 1]])
            a += x
            b += y
        join = lambda x: pa.array(np.concatenate(x or [np.zeros(0, np.uint64)]).view(np.int64))
        return pa.RecordBatch.from_arrays([join(a), join(b)], ["a", "b"])

    for batch in batches:
        rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        if kept is not None:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows))
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        kept = tuple(x[cut:] for x in rows)
        if cut:
            yield links(*(x[:cut] for x in rows))
    if kept is not None and len(kept[0]):
        yield links(*kept)


def fingerprint_links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that join up every two of the distinct fingerprints `fp` within TAU bits."""
    spark = prints.sparkSession
    keyed = prints.select(F.explode(_chain_keys(F.col("fp"))).alias("key"), "fp")
    large = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK))
    usual = keyed.join(large, "key", "left_anti").select("key", F.lit(0).cast("long").alias("block"), "fp")
    cut = keyed.join(large, "key").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long") + 1)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    each = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = each.select("key", (1 + F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("block"), "fp")
    n = default_partitions(spark)
    sort = lambda df: df.repartition(n, "key", "block").sortWithinPartitions("key", "block")
    return sort(usual.union(blocks)).mapInArrow(_link_batches, "a long, b long").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, fp), and (fp, least_id, root) of each fingerprint."""
    rows = scratch.write(fingerprints(docs, id_col, text_col, shingle))
    prints = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = connected_components(fingerprint_links(prints, scratch), "a", "b", scratch)
    return rows, prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for every row: component_id is the smallest id reachable.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows stay rows. A
    null id takes part with its text and never becomes a component's id (null where no member has one).
    An empty table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, rooted = _components(docs, id_col, text_col, shingle, scratch)
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
