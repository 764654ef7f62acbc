import zlib

from bytelode.llm.sharding import shard_by_size

SCHEMA = "doc_id long, text string, part string, start long"


def shards(spark, rows, n):
    got = shard_by_size(spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(3), n).collect()
    return sorted((r.shard, r.slot, r.doc_id, r.size, r.text_crc32) for r in got)


def expected(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None and 1 + zlib.crc32(r[1].encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 8 for _, t in rows]
    start, out, slots = 0, [], {}
    for (i, t), s in zip(rows, sizes):
        k = min(n - 1, (2 * start + s) * n // (2 * sum(sizes)))
        out.append((k, slots.setdefault(k, 0), i, s, None if t is None else zlib.crc32(t.encode())))
        slots[k] += 1
        start += s
    return out


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = [(i, "é" * (i * 37 % 101)) for i in range(300)]
    assert shards(spark, rows, 7) == expected(rows, 7)


def test_nulls_repeats_long_texts_and_few_rows(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "a"), (2, "a"), (3, "long " * 40_000), (4, "b")]
    got = shards(spark, rows, 3)
    assert sorted(got, key=str) == sorted(expected(rows, 3), key=str)


def test_empty_table(spark):
    assert shards(spark, [], 4) == []
