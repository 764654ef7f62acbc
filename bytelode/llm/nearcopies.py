"""The pipeline's near-copy stage: SimHash with pigeonring filtering for a similarity of 0.8, verified.

Shingles of five words, each once a text, and 256 bits. Texts whose shingle sets have a Jaccard similarity of 0.8 differ in
39 bits on average, with a deviation of 6, so that no exact part of a ring tells candidates from others
(op3's four bits of 64 ask for 0.96). Candidates are therefore texts that agree in one of BANDS keys,
each made of the least values of LEAST_OF hash functions over the shingles; at 0.8 one in 3,000 pairs
shares none. Chains on a ring of eight segments, each within its share of TAU, and then all bits prune them: TAU
is 53, which 99 % of pairs at 0.8 pass. What is left is held against the shingle sets themselves, and only
pairs at LEAST or more link.

Equal shingle sets are one node throughout. Buckets give all pairs that pass up to SMALL nodes, larger ones spanning
forests, dealt in pairs of blocks, as in simhash.py. Where verified links leave the nodes of a large bucket in
several components, its pairs across components that pass the bits are verified in a second round, in the task that
holds the two blocks, so that none is lost and none is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, packed, row_hash, unpacked
from .components import connected_components
from .simhash import BLOCK, SMALL, _majority, shingle_hashes

SHINGLE, WORDS, TAU, LEAST = 5, 4, 53, 0.8
#: Segments of the ring, of 32 bits each, and what chains of 1 to SEGMENTS of them may differ in.
SEGMENTS = 2 * WORDS
BUDGETS = np.array([length * TAU // SEGMENTS for length in range(1, SEGMENTS + 1)])
BANDS, LEAST_OF = 20, 5
#: Bytes of text of a bucket that one task of the second round holds, about.
BLOCK_BYTES = 32 << 20
#: Values of hash functions that are held at once.
_TOGETHER = 256

_rng = np.random.default_rng(20)
_odd = lambda *shape: _rng.integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _MIX_ADD = _odd(2, WORDS), _odd(WORDS)
_TIMES, _PLUS, _FOLD = _odd(BANDS * LEAST_OF), _odd(BANDS * LEAST_OF), _odd(BANDS, LEAST_OF)


def wide_print(hashes: np.ndarray) -> list[int]:
    """Four words of 64 bits from the shingles' hashes; zeros for none."""
    out = []
    for k in range(WORDS):
        x = hashes * _MIX[0, k] + _MIX_ADD[k]
        x = (x ^ (x >> np.uint64(31))) * _MIX[1, k]
        x ^= x >> np.uint64(29)
        out.append(int.from_bytes(_majority(x.tobytes()), "little", signed=True) if len(x) else 0)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys on which near copies meet; texts without a word share theirs."""
    least = np.full(BANDS * LEAST_OF, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _TOGETHER):
        least = np.minimum(least, (hashes[at : at + _TOGETHER, None] * _TIMES + _PLUS).min(axis=0))
    mixed = (least.reshape(BANDS, LEAST_OF) ^ (least.reshape(BANDS, LEAST_OF) >> np.uint64(32))) * _FOLD
    return mixed.sum(axis=1, dtype=np.uint64).view(np.int64)


def shingles(text: bytes | None) -> np.ndarray:
    """The hashes of a text's different shingles, sorted."""
    return np.unique(np.frombuffer(shingle_hashes(text, SHINGLE), ">u8").astype(np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys, sums = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            hashes = shingles(text.as_py())
            prints.append(wide_print(hashes))
            keys.append(band_keys(hashes))
            sums.append(int(hashes.sum(dtype=np.uint64).view(np.int64)))
        words = np.array(prints, np.int64).reshape(-1, WORDS)
        offsets = pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS), pa.int32())
        bands = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(words[:, k]) for k in range(WORDS)), pa.array(sums, pa.int64()), bands], ["id", "text_hash", "size", *_NAMES, "total", "keys"])


_NAMES = [f"w{k}" for k in range(WORDS)]


def near(differ: np.ndarray) -> np.ndarray:
    """Which rows of differing bits, WORDS words each, link: first the chains, then all bits."""
    parts = np.bitwise_count(np.ascontiguousarray(differ).view(np.uint32)).astype(np.int32)
    ring = np.concatenate([np.zeros((len(parts), 1), np.int32), parts, parts], axis=1).cumsum(axis=1)
    held = np.zeros(len(parts), bool)
    for start in range(SEGMENTS):
        held |= (ring[:, start + 1 : start + 1 + SEGMENTS] - ring[:, start : start + 1] <= BUDGETS).all(axis=1)
    held[held] = ring[held, SEGMENTS] <= TAU
    return held


def _forest(words: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket, as places in it."""
    left, a, b = np.arange(len(words)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            top = queue.pop()
            linked = near(words[left] ^ words[top])
            got, left = left[linked], left[~linked]
            a += [top] * len(got)
            b += got.tolist()
            queue += got.tolist()
    return a, b


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block) come in; links go out. A bucket may span batches."""
    kept: tuple[np.ndarray, ...] | None = None

    def links(key: np.ndarray, block: np.ndarray, node: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        bounds = np.concatenate(([0], cuts, [len(key)]))
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few, a, b = sizes[group] <= SMALL, [], []
        for step in range(1, SMALL):
            at = np.flatnonzero((group[step:] == group[:-step]) & few[step:]) if step < len(group) else np.zeros(0, np.int64)
            if not len(at):
                break
            at = at[near(words[at] ^ words[at + step])]
            a.append(node[at])
            b.append(node[at + step])
        for g in np.flatnonzero(sizes > SMALL):
            inside = slice(bounds[g], bounds[g + 1])
            x, y = _forest(words[inside])
            a.append(node[inside][x])
            b.append(node[inside][y])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([join(a), join(b)], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = columns[0], columns[1], columns[2], np.stack(columns[3:], axis=1).view(np.uint64)
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


def _groups(batches: Iterator[pa.RecordBatch], heads: int) -> Iterator[list[pa.Array]]:
    """The rows of each run of equal values in the first `heads` columns; a run may span batches."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        if not kept.num_rows:
            continue
        keys = np.stack([kept.column(k).to_numpy() for k in range(heads)], axis=1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for start, end in zip([0, *cuts[:-1]], cuts):
            yield [c.combine_chunks() for c in kept.slice(start, end - start).columns]
        kept = kept.slice(cuts[-1]) if len(cuts) else kept
    if kept is not None and kept.num_rows:
        yield [c.combine_chunks() for c in kept.columns]


def _crossing(words: np.ndarray, roots: np.ndarray, at: int) -> np.ndarray:
    """Places after `at` of another component that pass the bits."""
    other = at + 1 + np.flatnonzero(roots[at + 1 :] != roots[at])
    return other[near(words[other] ^ words[at])]


def _doubtful_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, node, root, words ...) by key and block come in; (key, node) of those in a pair across components go out."""
    for columns in _groups(batches, 2):
        key, _, node, root, *words = (c.to_numpy() for c in columns)
        words, held = np.stack(words, axis=1).view(np.uint64), np.zeros(len(node), bool)
        for at in range(len(node)) if root.min() != root.max() else ():
            got = _crossing(words, root, at)
            held[got] = True
            held[at] |= len(got) > 0
        yield pa.RecordBatch.from_arrays([pa.array(key[held]), pa.array(node[held])], ["key", "node"])


def _crossing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, node, root, words ..., text) come in; verified links (a, b) across components go out, a forest's."""
    for columns in _groups(batches, 2):
        _, _, node, root, *words = (c.to_numpy() for c in columns[:-1])
        words, texts, sets, a, b = np.stack(words, axis=1).view(np.uint64), columns[-1], {}, [], []
        now = root.copy()
        for at in range(len(node)):
            for other in _crossing(words, now, at).tolist():
                if now[other] == now[at]:
                    continue
                for k in (at, other):
                    if k not in sets:
                        sets[k] = shingles(texts[k].as_py())
                if similarity(sets[at], sets[other]) >= LEAST:
                    a.append(node[at])
                    b.append(node[other])
                    now[now == now[other]] = now[at]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) come in, best by a; the pairs at LEAST or more go out."""
    last, held = None, None
    for batch in batches:
        keep = []
        for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if a != last:
                last, held = a, shingles(text_a.as_py())
            keep.append(similarity(held, shingles(text_b.as_py())) >= LEAST)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _dealt(keyed: DataFrame, blocks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (key, block, columns ...): each row goes to every pair of blocks that holds its own; `blocks` has (key, blocks)."""
    cut = keyed.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut.select("key", (1 + F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("block"), *columns)


def _met_keys(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, rows) of keys of two nodes or more."""
    return scratch.write(prints.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))


def print_links(prints: DataFrame, scratch: Scratch, met: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of nodes that pass the bits, from (node, w0 ... w3, keys): all pairs of small buckets, forests of large ones."""
    met = _met_keys(prints, scratch) if met is None else met
    # Nearly all keys occur once: they are counted bare, and only rows that meet others move with their words.
    keyed = prints.select(F.explode("keys").alias("key"), "node")
    kept = keyed.join(met, "key").select("node", "key", "rows").groupBy("node").agg(F.collect_list(F.struct("key", "rows")).alias("met"))
    wide = prints.select("node", *_NAMES).join(kept, "node").select("node", *_NAMES, F.explode("met").alias("m")).select("m.key", "m.rows", "node", *_NAMES)
    usual = wide.where(F.col("rows") <= BLOCK).select("key", F.lit(0).cast("long").alias("block"), "node", *_NAMES)
    large = met.where(F.col("rows") > BLOCK).select("key", (F.ceil(F.col("rows") / BLOCK).cast("long") + 1).alias("blocks"))
    blocks = _dealt(wide.where(F.col("rows") > BLOCK), large, ["node", *_NAMES])
    dealt = usual.union(blocks).repartition(default_partitions(prints.sparkSession), "key", "block").sortWithinPartitions("key", "block", "node")
    return dealt.mapInArrow(_link_batches, "a long, b long").distinct()


def verified_links(prints: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links of nodes whose texts have a similarity of LEAST, as many as join what any such links join.

    `prints` has (node, w0 ... w3, keys, one: text_hash, size, id), `texts` (id, text_hash, text).
    """
    parts, met = default_partitions(prints.sparkSession), _met_keys(prints, scratch)
    pairs = scratch.write(print_links(prints, scratch, met))
    ends = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # By id, too: the copies of a text don't meet in one task.
    wanted = prints.join(ends, "node", "left_semi").select("node", F.col("one.text_hash").alias("_hash"), F.col("one.id").alias("_id"))
    found = texts.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")))
    known = scratch.write(found.groupBy("node").agg(F.first(F.col("text").cast("binary")).alias("text")))
    side = lambda x: known.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    links = scratch.write(both.mapInArrow(_verify_batches, "a long, b long"))
    # The second round: large buckets whose nodes are not all linked.
    large = met.where(F.col("rows") > SMALL).select("key")
    keyed = prints.join(ends, "node", "left_semi").select("node", F.col("one.size").alias("size"), *_NAMES, F.explode("keys").alias("key")).join(large, "key", "left_semi")
    roots = connected_components(links, "a", "b", scratch).select(F.col("node").alias("of"), "root")
    placed = scratch.write(keyed.join(roots, F.col("node") == F.col("of"), "left").select("key", "node", "size", *_NAMES, F.coalesce("root", "node").alias("root")))
    blocks = F.when(F.col("rows") > BLOCK, F.ceil(F.col("rows") / BLOCK) + 1).otherwise(1).cast("long")
    torn = scratch.write(placed.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", blocks.alias("blocks")))
    if torn.isEmpty():
        return links
    columns = ["node", "root", *_NAMES]
    spread = lambda rows: rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "node")
    doubtful = scratch.write(spread(_dealt(placed, torn, columns)).mapInArrow(_doubtful_batches, "key long, node long").distinct())
    if doubtful.isEmpty():
        return links
    few = placed.join(doubtful, ["key", "node"]).join(known, "node")
    cut = few.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).cast("long").alias("blocks"))
    more = spread(_dealt(few, cut, [*columns, "text"])).mapInArrow(_crossing_batches, "a long, b long")
    return links.union(scratch.write(more))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the smallest (id, text hash) stays, once.

    Groups are what links reach. Rows are told apart by id and text, so another text under the same id is
    a row of its own. A group's rows without an id cannot be named: of these too one stays, that of the
    smallest text hash, beside the named one. Null and wordless texts are copies of each other. An empty
    table gives no rows.
    """
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = texts.mapInArrow(_print_batches, f"id long, text_hash long, size long, {', '.join(f'{w} long' for w in _NAMES)}, total long, keys array<long>")
    own = F.struct("id", "text_hash")
    named, unnamed = (F.min(F.when(is_, own)) for is_ in (F.col("id").isNotNull(), F.col("id").isNull()))
    # Equal sets have equal keys.
    grouped = scratch.write(rows).groupBy(*_NAMES, "total").agg(named.alias("named"), unnamed.alias("unnamed"), F.min(F.struct("text_hash", "size", "id")).alias("one"), F.first("keys").alias("keys"))
    prints = scratch.write(grouped.select(*_NAMES, "named", "unnamed", "one", "keys", F.monotonically_increasing_id().alias("node")))
    links = verified_links(prints, texts.select("id", "text_hash", "text"), scratch)
    roots = connected_components(links, "a", "b", scratch).select(F.col("node").alias("of"), "root")
    rooted = prints.select("node", "named", "unnamed").join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed"))
    keep = scratch.write(firsts.select(F.explode(F.array_compact(F.array("named", "unnamed"))).alias("first")).select("first.id", "first.text_hash").distinct())
    hashed = packed(docs, doc=F.col("doc_id").cast("long"), text_hash=F.xxhash64("text"), order=row_hash(docs))
    left = hashed.join(keep, hashed["doc"].eqNullSafe(keep["id"]) & (hashed["text_hash"] == keep["text_hash"]), "left_semi")
    # Repeats of the row that stays may differ in other columns; the choice must not hang on the layout.
    return unpacked(left.groupBy("doc", "text_hash").agg(F.min_by("row", "order").alias("row")))
