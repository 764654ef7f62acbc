"""One order of all suffixes of a corpus, in which a suffix moves once.

Of two suffixes with the same first KEY bytes the order is that of what follows, so suffixes need be told apart beyond these
bytes at few places only. A suffix's anchor is the place of the least hash among the WINDOW four-byte windows it starts with (minimizers:
Roberts et al. 2004): equal first bytes have equal anchors. Anchors, about a tenth of all places, are ordered by prefix doubling from anchor
to anchor; then each suffix goes, packed with others, to the task of its range, which sorts by (first bytes, rank of the anchor).
The anchor of a suffix shorter than KEY is the text's end, whose rank is that of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.patterns import KEY_BYTES
from ..session import default_partitions
from ..sources.blocks import BlockTexts
from .prefix import sum_before

GRAM = 4
KEY = 3 * KEY_BYTES
#: An anchor's first KEY bytes decide its own next anchor too, so windows end a byte before them.
WINDOW = KEY - GRAM
#: Blocks hold this much at least, so that a block sees all it needs in the blocks beside it.
LEAST_BLOCK = 64
#: Bytes of text that a task lays out at once.
SLICE = 1 << 20
#: Suffixes of a range, about.
RANGE = 2_000_000
#: Suffixes drawn for each range to find where it ends.
DRAWN = 50
#: Rows that a task sends at once.
SEND = 200_000
#: Columns of a packed suffix: its first bytes, (bytes up to KEY, anchor's rank), place in the block, text's number in the pack, byte before.
PACKED = (("keys", (">u8", 3)), ("tail", "<u8"), ("at", "<u4"), ("of", "<u4"), ("before", "<i2"))


def _wide(blocks: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of LEAST_BLOCK bytes or more."""
    if size >= LEAST_BLOCK:
        return blocks, size
    by = -(-LEAST_BLOCK // size)
    joined = blocks.groupBy("id", F.expr(f"block div {by}").alias("wide")).agg(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY block)").alias("data"))
    return joined.select("id", F.col("wide").alias("block"), F.coalesce("data", F.lit(b"")).alias("data")), size * by


def _seen(blocks: DataFrame, size: int) -> DataFrame:
    """(id, block, own, lead, ends, text): blocks with `lead` bytes before and up to KEY behind them (so that the place behind the last one is seen to end or not), and zeros."""
    ahead = BlockTexts(blocks, size).with_ahead(KEY)
    before = blocks.select(F.col("id").alias("_id"), (F.col("block") + 1).alias("_block"), F.expr(f"substring(data, -{WINDOW}, {WINDOW})").alias("_last"))
    met = ahead.join(before, F.col("id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block")), "left")
    text = F.concat(F.coalesce("_last", F.lit(b"")), "data", F.coalesce("head", F.lit(b"")), F.lit(bytes(KEY)))
    return met.select("id", "block", F.octet_length("data").alias("own"), F.coalesce(F.octet_length("_last"), F.lit(0)).alias("lead"), F.col("head").isNull().alias("ends"), text.alias("text"))


class _Laid:
    """Rows of `_seen` laid one after the other: for every byte of them its row, and what starts there."""

    def __init__(self, batch: pa.RecordBatch):
        cell = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.bytes = np.frombuffer(data, np.uint8)
        self.block, own, lead = cell("block"), cell("own").astype(np.int64), cell("lead").astype(np.int64)
        self.first = offsets[:-1] + lead  # where the block's own bytes start
        self.end = offsets[1:] - KEY  # behind the last byte seen
        n = int(offsets[-1])
        self.row = np.repeat(np.arange(len(batch)), np.diff(offsets))
        places = np.arange(n)
        self.left = np.minimum(self.end[self.row] - places, KEY)
        upto = self.first + own + cell("ends")  # the empty suffix belongs to the last block
        self.own = (places >= self.first[self.row]) & (places < upto[self.row])
        padded = data + bytes(2 * KEY)
        self.words = np.ndarray(n + KEY, ">u8", padded, strides=(1,))
        # Anchors: the least hash, then the first place.
        least = np.ndarray(n + KEY, ">u4", padded, strides=(1,)).astype(np.uint32)
        for k, factor in ((15, 0x9E3779B1), (13, 0x85EBCA6B)):
            least = (least ^ (least >> np.uint32(k))) * np.uint32(factor)
        least = (least.astype(np.uint64) << np.uint64(32)) | np.arange(n + KEY, dtype=np.uint64)
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        anchor = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.anchor = np.where(self.left < KEY, self.end[self.row], anchor)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with about SLICE bytes of text together."""
    total = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    cuts = np.concatenate(([0], 1 + np.flatnonzero(np.diff(total)), [len(batch)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _keys(laid: _Laid, at: np.ndarray) -> pa.Array:
    """The first KEY bytes at places."""
    sizes = laid.left[at]
    cells = np.arange(KEY)
    held = laid.bytes[np.minimum(at[:, None] + cells, len(laid.bytes) - 1)][cells < sizes[:, None]]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(held.tobytes())])


def _anchor_batches(size: int):
    """(id, pos, next, key) of the anchors in blocks and of texts' ends; `next` is the anchor behind, null where the key is all there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                laid = _Laid(batch)
                told = np.zeros(len(laid.row), bool)
                told[laid.anchor[laid.left == KEY]] = True
                told |= laid.left == 0
                at = np.flatnonzero(told & laid.own)
                row = laid.row[at]
                place = lambda spots, row=row, laid=laid: laid.block[row] * size + spots - laid.first[row]
                behind = pa.array(place(laid.anchor[at + 1 - (laid.left[at] == 0)]), pa.int64(), mask=laid.left[at] < KEY)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(place(at)), behind, _keys(laid, at)], ["id", "pos", "next", "key"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, pos, next, key) in key order get the task's number, the row where their bucket of equal keys starts and whether it holds several."""
    part, held, tied, count, start, last = TaskContext.get().partitionId(), None, None, 0, 0, None

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*held[0].columns, pa.array(np.full(len(held[0]), part, np.int32)), pa.array(held[1]), pa.array(tied)], ["id", "pos", "next", "key", "part", "start", "tied"])

    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key")
        same = np.concatenate(([last is not None and key[0].as_py() == last], pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))).astype(bool)
        starts = np.maximum.accumulate(np.where(same, start, count + np.arange(len(batch))))
        if held is not None:
            tied[-1] |= same[0]
            yield send()
        held, tied = (batch, starts), same | np.append(same[1:], False)
        count, start, last = count + len(batch), int(starts[-1]), key[len(key) - 1].as_py()
    if held is not None:
        yield send()


def _by_key(anchors: DataFrame, save) -> DataFrame:
    """(id, pos, next, bucket, tied, ended): `bucket` is how many rows have smaller keys, `tied` whether others have the same."""
    spark = anchors.sparkSession
    kinds = ", ".join(f"{c} {anchors.schema[c].dataType.simpleString()}" for c in anchors.columns)
    dealt = anchors.repartitionByRange(default_partitions(spark), "key", "id", "pos").sortWithinPartitions("key")
    rows = save(dealt.mapInArrow(_numbered, f"{kinds}, part int, start long, tied boolean"))
    # A row for each partition: where it starts, and buckets that go on from one to the next.
    edges, offset, before = [], 0, None
    for r in sorted(rows.groupBy("part").agg(F.count("*"), F.min("key"), F.max("key"), F.max("start")).collect()):
        part, n, low, high, last = r
        goes_on = before is not None and low == before[0]
        if goes_on:
            edges[-1][4] = True
        edges.append([part, offset, before[1] if goes_on else None, last, False])
        before = high, before[1] if goes_on and last == 0 else offset + last
        offset += n
    if not edges:
        edges = [[0, 0, None, 0, False]]
    told = F.broadcast(spark.createDataFrame([tuple(e) for e in edges], "part int, offset long, from long, last long, open boolean"))
    on = (F.col("start") == 0) & F.col("from").isNotNull()
    bucket = F.when(on, F.col("from")).otherwise(F.col("offset") + F.col("start"))
    tied = F.col("tied") | on | (F.col("open") & (F.col("start") == F.col("last")))
    return rows.join(told, "part").select("id", "pos", "next", bucket.alias("bucket"), tied.alias("tied"), (F.octet_length("key") < KEY).alias("ended"))


def _anchor_ranks(anchors: DataFrame, save) -> DataFrame:
    """(id, pos, rank) of anchors among all anchors, by doubling: in a round buckets of several are split by the bucket of the
    anchor behind, and then look behind that one. Buckets of suffixes that end are equal strings: their ids decide."""
    tables = [_by_key(anchors, save)]
    done = "not tied or ended"
    while not (open_ := tables[-1].where("tied and not ended")).isEmpty():
        known = reduce(DataFrame.union, [*(t.where(done) for t in tables[:-1]), tables[-1]])
        behind = known.select(F.col("id").alias("_id"), F.col("pos").alias("_pos"), F.col("next").alias("_next"), F.col("bucket").alias("behind"), F.col("ended").alias("stops"))
        paired = save(open_.join(behind, (F.col("id") == F.col("_id")) & (F.col("next") == F.col("_pos"))).select("id", "pos", F.col("_next").alias("next"), F.col("bucket").alias("head"), "behind", "stops"))
        sizes = paired.groupBy("head", "behind").agg(F.count("*").alias("n"), F.max("stops").alias("stops"))
        starts = sum_before(sizes, ["head"], ["behind"], {"inside": "n"}, save)
        split = paired.drop("stops").join(starts, ["head", "behind"])
        tables.append(save(split.select("id", "pos", "next", (F.col("head") + F.col("inside")).alias("bucket"), (F.col("n") > 1).alias("tied"), F.col("stops").alias("ended"))))
    settled = reduce(DataFrame.union, [t.where(done) for t in tables])
    ties = settled.where("tied").select("id", "pos", "bucket", F.lit(1).alias("one"))
    told = sum_before(ties, ["bucket"], ["id"], {"place": "one"}, save).select("id", "pos", (F.col("bucket") + F.col("place")).alias("rank"))
    return settled.where("not tied").select("id", "pos", F.col("bucket").alias("rank")).union(told)


def _suffixes(batch: pa.RecordBatch, size: int) -> tuple[_Laid, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the blocks' own suffixes, their first words (a column each) and (bytes up to KEY, anchor's rank) as one number."""
    laid = _Laid(batch)
    ranks = np.zeros(len(laid.row), np.uint64)
    of = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("places")).to_numpy(zero_copy_only=False))
    spots = batch.column("places").flatten().to_numpy() - laid.block[of] * size + laid.first[of]
    ranks[spots] = batch.column("ranks").flatten().to_numpy().astype(np.uint64)
    at = np.flatnonzero(laid.own)
    words = np.stack([laid.words[at + k * KEY_BYTES].astype(np.uint64) for k in range(3)])
    return laid, at, words, (laid.left[at].astype(np.uint64) << np.uint64(56)) | ranks[laid.anchor[at]]


def _drawn_batches(size: int, share: float):
    """The numbers that place some of the suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(TaskContext.get().partitionId())
        for whole in batches:
            for batch in _slices(whole):
                _, at, words, tail = _suffixes(batch, size)
                drawn = np.flatnonzero(random.random(len(at)) < share)
                cells = np.stack([*words[:, drawn], tail[drawn]], 1).astype(">u8")
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary())], ["place"])

    return run


def _range_batches(size: int, ends: np.ndarray):
    """(part, n, ids, data): suffixes packed by range; `ends` are where ranges but the first start, as rows of four numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                laid, at, words, tail = _suffixes(batch, size)
                by = np.argsort(words[0])
                at, words, tail = at[by], words[:, by], tail[by]
                part = np.searchsorted(ends[:, 0], words[0], "left").astype(np.int32)
                low, high = (np.searchsorted(words[0], ends[:, 0], side) for side in ("left", "right"))
                for k in np.flatnonzero(high > low):
                    here = slice(low[k], high[k])
                    reached = tail[here] >= ends[k, 3]
                    for column, end in ((words[2], ends[k, 2]), (words[1], ends[k, 1])):
                        reached = (column[here] > end) | ((column[here] == end) & reached)
                    part[here] += reached
                by = np.argsort(part, kind="stable")
                at, words, tail, part = at[by], words[:, by], tail[by], part[by]
                row = laid.row[at]
                whole_text = (at == laid.first[row]) & (laid.block[row] == 0)
                columns = {"keys": words.T, "tail": tail, "at": at - laid.first[row], "before": np.where(whole_text, -1, laid.bytes[at - 1].astype(np.int16))}
                starts = np.concatenate(([0], 1 + np.flatnonzero(np.diff(part)), [len(part)])) if len(part) else np.zeros(1, int)
                out: dict[str, list] = {"part": [], "n": [], "rows": [], "data": []}
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    rows, of = np.unique(row[a:b], return_inverse=True)
                    cells = {c: x[a:b] for c, x in columns.items()} | {"of": of}
                    # Byte by byte: the upper bytes of numbers are alike. Keys stay text.
                    flat = [np.ascontiguousarray(cells[c], kind[0] if c == "keys" else kind) for c, kind in PACKED]
                    planes = [x.tobytes() if c == "keys" else x.view(np.uint8).reshape(b - a, -1).T.tobytes() for (c, _), x in zip(PACKED, flat, strict=True)]
                    out["part"].append(part[a])
                    out["n"].append(b - a)
                    out["rows"].append(rows)
                    out["data"].append(pa.compress(b"".join(planes), codec="zstd", asbytes=True))
                if not out["n"]:
                    continue
                of = np.concatenate(out["rows"])
                lists = lambda values: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out["rows"])]), pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["part"], pa.int32()), pa.array(out["n"], pa.int64()), lists(batch.column("id").take(pa.array(of))), lists(pa.array(laid.block[of] * size)), pa.array(out["data"], pa.binary())],
                    ["part", "n", "ids", "starts", "data"],
                )

    return run


def _unpacked(n: int, data: bytes) -> dict[str, np.ndarray]:
    widths = {c: KEY if c == "keys" else np.dtype(kind).itemsize for c, kind in PACKED}
    plain, out, at = pa.decompress(data, n * sum(widths.values()), codec="zstd", asbytes=True), {}, 0
    for c, kind in PACKED:
        cells = np.frombuffer(plain, np.uint8, n * widths[c], at)
        at += n * widths[c]
        out[c] = cells.view(">u8").reshape(n, 3).astype(np.uint64) if c == "keys" else np.ascontiguousarray(cells.reshape(widths[c], n).T).view(kind).ravel()
    return out


def _sorted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, place, id, pos, bwt_byte, key8) of a range's suffixes in order."""
    packs: dict[int, list] = {}
    for batch in batches:
        for k in range(len(batch)):
            part, n, ids, starts, data = (batch.column(c)[k] for c in range(5))
            packs.setdefault(part.as_py(), []).append((n.as_py(), ids.values, starts.values.to_numpy(), data.as_py()))
    for part in sorted(packs):
        held = packs.pop(part)
        cells = [_unpacked(n, data) for n, _, _, data in held]
        shift = np.cumsum([0, *(len(ids) for _, ids, _, _ in held)])
        of = np.concatenate([c["of"].astype(np.int64) + s for c, s in zip(cells, shift[:-1], strict=True)])
        ids, starts = pa.concat_arrays([ids for _, ids, _, _ in held]), np.concatenate([s for _, _, s, _ in held])
        keys, tail, at, before = (np.concatenate([c[name] for c in cells]) for name in ("keys", "tail", "at", "before"))
        del cells, held
        order = np.lexsort((tail, keys[:, 2], keys[:, 1], keys[:, 0]))
        first = keys[:, 0].astype(">u8").view(np.uint8).reshape(-1, KEY_BYTES)
        for a in range(0, len(order), SEND):
            some = order[a : a + SEND]
            sizes = np.minimum((tail[some] >> np.uint64(56)).astype(np.int64), KEY_BYTES)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            key8 = first[some][np.arange(KEY_BYTES) < sizes[:, None]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), part, np.int32)),
                    pa.array(np.arange(a, a + len(some))),
                    ids.take(pa.array(of[some])),
                    pa.array(starts[of[some]] + at[some]),
                    pa.array(before[some].astype(np.int32), mask=before[some] < 0),
                    pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(key8.tobytes())]),
                ],
                ["part", "place", "id", "pos", "bwt_byte", "key8"],
            )


def suffix_ranges(blocks: DataFrame, size: int, save, suffixes: int = RANGE) -> DataFrame:
    """(part, place, id, pos, bwt_byte, key8) of all suffixes of texts in blocks (id, block, data): ranges of the one order,
    about `suffixes` in each, and the place of each suffix in its range. A partition holds a range in order."""
    spark = blocks.sparkSession
    wide, size = _wide(blocks, size)
    seen = save(_seen(wide, size))
    kind = seen.schema["id"].dataType.simpleString()
    ranks = _anchor_ranks(seen.mapInArrow(_anchor_batches(size), f"id {kind}, pos long, next long, key binary"), save)
    # A block's suffixes have anchors in it and at the start of the next one.
    own = F.expr(f"pos div {size}")
    asked = ranks.withColumn("block", F.explode(F.when((F.col("pos") >= size) & (F.col("pos") % size < KEY), F.array(own, own - 1)).otherwise(F.array(own))))
    packs = asked.groupBy("id", "block").agg(F.collect_list(F.struct("pos", "rank")).alias("of")).select("id", "block", F.col("of.pos").alias("places"), F.col("of.rank").alias("ranks"))
    ready = save(seen.join(packs, ["id", "block"]))
    total = ready.agg(F.sum(F.col("own").cast("long") + F.col("ends").cast("int"))).first()[0] or 0
    parts = max(default_partitions(spark), -(-total // suffixes))
    drawn = sorted(bytes(r[0]) for r in ready.mapInArrow(_drawn_batches(size, min(1.0, parts * DRAWN / max(1, total))), "place binary").collect())
    cuts = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []
    ends = np.frombuffer(b"".join(cuts), ">u8").astype(np.uint64).reshape(-1, 4)
    packed = ready.mapInArrow(_range_batches(size, ends), f"part int, n long, ids array<{kind}>, starts array<long>, data binary")
    return packed.repartitionById(len(cuts) + 1, "part").mapInArrow(_sorted_batches, f"part int, place long, id {kind}, pos long, bwt_byte int, key8 binary")


def with_ranks(ranges: DataFrame) -> DataFrame:
    """Adds `rank` to the rows of `suffix_ranges`, once they are stored."""
    spark, before, starts = ranges.sparkSession, 0, []
    for part, n in sorted(map(tuple, ranges.groupBy("part").agg(F.count("*")).collect())):  # a row for each range
        starts.append((part, before))
        before += n
    told = spark.createDataFrame(starts, "part int, before long")
    return ranges.join(F.broadcast(told), "part").withColumn("rank", F.col("before") + F.col("place"))
