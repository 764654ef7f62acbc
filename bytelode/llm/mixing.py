"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's target over its size.
The fractional parts are rounded in pairs: mass (fraction times words) moves from one document to the
other, the way drawn at random so that both expectations hold, until one fraction is 0 or 1. The other
goes on to the next pair. So a source's taken words change by nothing but its very last fraction: they
miss the target by less than one document. Pairs meet in salted buckets; what a bucket cannot settle,
one document a source, goes up a tree of buckets until one is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import sum_before
from .common import WORD_SEPARATORS, Scratch, default_partitions, packed, row_hash, table, unpacked

#: Buckets that a source is dealt to, and buckets that meet in one on the next level.
BUCKETS = 4096
FAN_IN = 64
#: Documents of a source that wait for the last bucket, about: from the smallest quarter at most, by powers of two.
WAITING = 2048
#: A source is taken so often at most.
MOST = 3
_TINY = 1e-9
#: Equal rows that are told apart at once.
_STEP = 4096
_SCHEMA = "bucket long, source string, id long, text_hash long, size long, copies long, x double, open boolean, row_hash long, same long"


def source_targets(sizes: DataFrame, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources weigh 1, 2, 3, 1, 2, 3 ... by code point, null last. All words are shared out by weight; a
    target stops at `most` times its source and the excess goes to the others by weight. The fixed point
    is target = min(most * size, level * weight): sources stop in order of size over weight. Ranks and
    sums run over range partitions, so sources may be as many as web hosts.
    """
    scratch = scratch or Scratch(sizes.sparkSession)
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).alias("one"))
    ranked = sum_before(named, [], ["last", "source"], {"rank": "one"}, scratch.write)
    weighed = ranked.withColumn("weight", 1 + F.col("rank") % 3).withColumn("ratio", F.col("source_size") / F.col("weight"))
    levels = sum_before(weighed, [], ["ratio", "last", "source"], {"before": "source_size", "weights": "weight"}, scratch.write)
    totals = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    levels = levels.withColumn("level", (totals["size"] - most * F.col("before")) / (totals["weight"] - F.col("weights")))
    # The first source, by ratio, that its level does not fill sets the level of all from there on.
    unfilled = levels.where(F.col("level") * F.col("weight") < most * F.col("source_size"))
    first = unfilled.agg(F.min(F.struct("ratio", "last", "source", "level")).alias("m")).select("m.level").first()[0]
    target = F.least(most * F.col("source_size").cast("double"), F.lit(first or 0.0) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _waiting(classes: DataFrame) -> DataFrame:
    """(waits_of, waits, share): documents of a source with `waits` bits in their size at most wait, about this share of them."""
    upto = W.partitionBy("source").orderBy("bits").rowsBetween(W.unboundedPreceding, 0)
    summed = classes.where("bits > 0").select("source", "bits", F.sum("n").over(upto).alias("upto"), F.sum("n").over(W.partitionBy("source")).alias("all"))
    enough = summed.where(F.col("upto") >= F.least(F.lit(WAITING), F.ceil(F.col("all") / 4)))
    first = enough.groupBy(F.col("source").alias("waits_of")).agg(F.min(F.struct("bits", "upto")).alias("m"))
    return first.select("waits_of", F.col("m.bits").alias("waits"), (WAITING / F.col("m.upto")).alias("share"))


def _draw(seed: int, level: int, *parts) -> float:
    return xxhash.xxh64_intdigest(repr((level, parts)), seed) / 2.0**64


def _settle(i: list, j: list, seed: int, level: int) -> None:
    """Moves mass between two open documents until one of them, at least, is settled."""
    to_i = min(i[4] * (1 - i[6]), j[4] * j[6])
    to_j = min(i[4] * i[6], j[4] * (1 - j[6]))
    up = _draw(seed, level, i[2], i[3], j[2], j[3]) * (to_i + to_j) < to_j
    moved = to_i if up else -to_j
    for doc, by in ((i, moved), (j, -moved)):
        x = doc[6] + by / doc[4]
        if x < _TINY or x > 1 - _TINY:
            doc[5:8] = doc[5] + round(x), 0.0, False
        else:
            doc[6] = x


def _settle_all(docs: list[list], seed: int, level: int) -> None:
    """Settles the open documents of one source, sorted by falling size: each is paired with all after it as one.

    What those give or take is shared in proportion, so their fractions are a * x + b with the same a and b for all. A
    document so large that the others can make up for it in one way only goes that way: its expectation gives way to the sum.
    """
    mass, weight = sum(d[4] * d[6] for d in docs), sum(d[4] for d in docs)
    a, b = 1.0, 0.0
    for doc in docs:
        size, x = doc[4], min(1.0, max(0.0, a * doc[6] + b))
        mass, weight = mass - size * doc[6], weight - size
        held = min(float(weight), max(0.0, a * mass + b * weight))  # what the others take part with, and their room
        room = weight - held
        to_doc, to_rest = min(size * (1 - x), held), min(size * x, room)
        if to_doc + to_rest > _TINY:
            up, down = held >= size * (1 - x), room >= size * x
            if up if up != down else _draw(seed, level, doc[2], doc[3]) * (to_doc + to_rest) < to_rest:
                x, keep = x + to_doc / size, 1 - to_doc / held
                a, b = a * keep, b * keep
            else:
                x, keep = x - to_rest / size, 1 - to_rest / room
                a, b = a * keep, b * keep + 1 - keep
        elif _TINY < x < 1 - _TINY:
            x = float(_draw(seed, level, doc[2], doc[3]) < x)
        if _TINY < x < 1 - _TINY:  # all others are settled by now
            x = float(_draw(seed, level + 1, doc[2], doc[3]) < x)
        doc[5:8] = doc[5] + round(x), 0.0, False


def _fold(seed: int, level: int, last: bool):
    """Rows sorted by (bucket, source), the largest first, come in and go out; of a bucket and source one document
    stays open at most, and none on the last level, which holds few of each source."""
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]

    def table_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                doc = list(row)
                if held is not None and held[:2] != doc[:2]:
                    done.append(held)
                    held = None
                if not doc[7]:
                    done.append(doc)
                elif held is None:
                    held = doc
                else:
                    _settle(held, doc, seed, level)
                    done += [d for d in (held, doc) if not d[7]]
                    held = next((d for d in (held, doc) if d[7]), None)
            yield table_of(done)
        if held is not None:
            yield table_of([held])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[list] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:2] != list(row[:2]):
                    _settle_all(group, seed, level)
                    yield table_of(group)
                    group = []
                group.append(list(row))
        _settle_all(group, seed, level)
        yield table_of(group)

    return settled if last else folded


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: int = 7, scratch: Scratch | None = None, tie: Column | None = None) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, copies) for every row.

    With `tie`, a column that tells rows of one id and text apart, row_hash returns it.

    Size is the number of words; null text has none. A null source is a source of its own, the last. The
    order in which documents meet, and so every draw, is set by ids, texts and the seed alone: reruns
    and other layouts of the same rows agree. Repeated rows are rounded together and differ by one copy at most. Rows without words
    take no part in the mass and round their copies alone. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    slim = scratch.write(
        docs.select(
            F.col(source_col).cast("string").alias("source"),
            F.col(id_col).cast("long").alias("id"),
            F.xxhash64(text_col).alias("text_hash"),
            (F.lit(0).cast("long") if tie is None else tie).alias("row_hash"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_SEPARATORS.replace("[", "[^"))), F.lit(0)).cast("long").alias("size"),
        )
    )
    slim = scratch.write(slim.groupBy("source", "id", "text_hash", "row_hash", "size").agg(F.count("*").alias("same")))
    bits = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    classes = scratch.write(slim.groupBy("source", bits.alias("bits")).agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("same")).alias("size")))
    targets = scratch.write(source_targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), most, scratch))
    # A row for each source; Spark broadcasts it where it is small.
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    kind = _waiting(classes).join(targets.select(F.col("source").alias("of"), rate.alias("rate")), F.col("waits_of").eqNullSafe(F.col("of")), "right")
    total = F.col("same") * F.col("rate")
    whole = F.floor(total + _TINY)
    part = F.greatest(total - whole, F.lit(0.0))
    drawn = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id", "text_hash"), F.lit(1 << 53)) / float(1 << 53)
    open_ = (F.col("size") > 0) & (part > _TINY)
    rows = slim.join(kind, F.col("source").eqNullSafe(F.col("of"))).select(
        F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.lit(BUCKETS)).alias("bucket"),
        "source", "id", "text_hash", "size",
        (whole + F.when((F.col("size") == 0) & (drawn(0) < part), 1).otherwise(0)).cast("long").alias("copies"),
        F.when(open_, part).otherwise(0.0).alias("x"),
        open_.alias("open"),
        "row_hash", "same",
        (open_ & (bits <= F.col("waits")) & (drawn(1) < F.col("share"))).alias("late"),
    )
    rows = scratch.write(rows.withColumn("late", F.coalesce("late", F.lit(False))))
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    n, settled, level_rows = default_partitions(docs.sparkSession), [rows.where("not open").select(names)], rows.where("open and not late").select(names)
    for level in range(1 + math.ceil(math.log(BUCKETS, FAN_IN))):
        last = FAN_IN**level >= BUCKETS
        if last:
            level_rows = level_rows.union(rows.where("late").withColumn("bucket", F.lit(0).cast("long")).select(names))
        dealt = level_rows.repartition(n, "bucket", "source").sortWithinPartitions("bucket", "source", F.desc("size"), "id", "text_hash", "row_hash")
        folded = scratch.write(dealt.mapInArrow(_fold(seed, level, last), _SCHEMA))
        settled.append(folded.where("not open"))
        level_rows = folded.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    done = reduce(DataFrame.union, settled)
    # Equal rows share their copies; in two steps, so that no long list is made.
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(_STEP).cast("long"))).alias("from")
    each = done.select("source", "id", "text_hash", "size", "copies", "row_hash", "same", steps)
    each = each.select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + _STEP, F.col("same")) - 1)).alias("k")).withColumn("copies", F.expr("copies div same + if(k < copies % same, 1, 0)"))
    return each.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "text_hash", "size", "source_size", "target", "copies", *([] if tie is None else ["row_hash"])
    )


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def take_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, and not at all where it takes none.

    Rows are told apart by all their columns, so a repeated id or text under other columns is a row of its
    own; rows equal in all of them are each rounded, and their copies are the same whichever is taken.
    Null and wordless texts round alone. An empty table gives no rows.
    """
    taken = mix(docs, tie=row_hash(docs)).groupBy("row_hash", F.coalesce("doc_id", F.lit(0)).alias("key")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    copies = taken.select("row_hash", "key", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    # The keys are never null, so that one shuffle of the rows serves both their repeats and the join.
    once = packed(docs, row_hash=row_hash(docs), key=F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).dropDuplicates(["row_hash", "key"])
    return unpacked(once.join(copies, ["row_hash", "key"]))
