import random

import numpy as np
import xxhash

from bytelode.llm import simhash
from bytelode.llm.common import Scratch
from bytelode.llm.components import connected_components
from bytelode.llm.nearcopies import keep_one_of_each
from bytelode.llm.simhash import fingerprint, fingerprint_links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, root long"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = ["", None, " \t\n", "One", "one two\x0bTHREE", "ÀÉ b c d e", "x " * 30_000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near).upper())
    return out


def test_fingerprint_is_the_plain_one():
    for t in texts():
        assert fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_spark_hash_agrees(spark):
    assert spark.sql("select xxhash64('one two three') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"one two three", seed=42)


def test_components_match_brute_force(spark):
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts())] + [(7, "a b c d e f", "c", 2), (None, "a b c d e f", "c", 2), (7, "a b c d e f", "c", 2)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    prints = {plain_fingerprint(r[1]) for r in rows}
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r in rows:
        if r[0] is not None:
            root = roots[plain_fingerprint(r[1])]
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted(str((r[0], f"{plain_fingerprint(r[1]):016x}", least[roots[plain_fingerprint(r[1])]])) for r in rows)
    assert sorted(str(tuple(r)) for r in got) == want
    assert any(r.doc_id != r.component_id for r in got)


def links(spark, values):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long").repartition(3)
    got = fingerprint_links(df, Scratch(spark)).collect()
    return [(r.a % 2**64, r.b % 2**64) for r in got]


def same_components(values, edges):
    linked = {frozenset(e) for e in edges}
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert plain_components(values, lambda a, b: frozenset((a, b)) in linked) == want


def test_all_links_are_found_at_every_distance(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            b ^= 1 << bit
        values |= {a, b}
    same_components(values, links(spark, values))


def test_dense_group_gives_few_links_and_blocks_lose_none(spark, monkeypatch):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 220:
        x = centre
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << bit
        values.add(x)
    edges = links(spark, values)
    same_components(values, edges)
    assert len(edges) < 10 * len(values)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    same_components(values, links(spark, values))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", Scratch(spark)).count() == 0


def test_empty_table_and_stage(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, "a b c d e", "", 1), (1, "A b c d e", "", 1), (1, "A b c d e", "", 1), (9, "other words entirely here now", "", 1), (None, "a b c d e", "", 1)]
    kept = keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    assert sorted(kept.collect(), key=str) == sorted([spark.createDataFrame([r], SCHEMA).first() for r in (rows[1], rows[3], rows[4])], key=str)


def test_stage_tells_rows_apart_by_id_and_text(spark):
    a, b, c = "a b c d e f g", "other words entirely here now", "third text with words of its own"
    rows = [(3, a, "", 1), (5, a, "", 1), (5, b, "", 1), (7, c, "", 1), (7, c, "", 2), (None, a, "", 1), (None, a, "", 1), (None, "only here and without any id", "", 1)]
    kept = [keep_one_of_each(spark, spark.createDataFrame(r, SCHEMA).repartition(n), "").collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert sorted(kept[0], key=str) == sorted(kept[1], key=str)
    assert sorted(((r.doc_id, r.text) for r in kept[0]), key=str) == sorted([(3, a), (5, b), (7, c), (None, a), (None, rows[-1][1])], key=str)
