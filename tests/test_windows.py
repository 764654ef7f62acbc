import random

import numpy as np
import pytest

from bytelode.operators import search, windows

DOCS = "doc_id long, text binary"


def places(text, pattern):
    """Each place of a pattern, by hand; one with a zero byte has none."""
    if b"\0" in pattern:
        return []
    at, out = text.find(pattern), []
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def texts_and_patterns():
    rng = random.Random(7)
    run = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    passage = run(b"abc", 400)
    docs = [(i, run(b"abAB", rng.randint(0, 300))) for i in range(30)] + [(40, b""), (41, None), (42, b"a\0b\0a"), (43, passage), (44, b"x" + passage[:300] + b"y" + passage), (None, b"abab" * 5), (45, b"z" * 700)]
    edge = (1 << 20) - 3  # a match spans the pieces that are hashed at once
    docs.append((50, b"q" * edge + b"needle in the text" + b"q" * edge))
    patterns = [run(b"abAB", rng.randint(1, 12)) for _ in range(80)] + [b"", b"\0", b"a\0b", passage[:63], passage[5:69], passage[5:70], passage[:128], passage[:129], passage[:200] + b"!", passage, b"needle", b"z" * 300, b"ab", b"ab", None]
    return docs, list(enumerate(patterns))


@pytest.mark.parametrize("ci", [False, True])
@pytest.mark.parametrize("shuffled", [False, True])
def test_a_table_of_patterns_finds_what_each_pattern_finds(spark, monkeypatch, ci, shuffled):
    if shuffled:
        monkeypatch.setattr(windows, "BROADCAST_ROWS", 0)
    docs, patterns = texts_and_patterns()
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    table = spark.createDataFrame(patterns, "id long, pattern binary")
    fold = (lambda x: x.lower()) if ci else (lambda x: x)
    want = {(i, k): places(fold(t), fold(p)) for i, t in docs if t is not None for k, p in patterns if p is not None}
    want = {key: at for key, at in want.items() if at}
    got = {(r.doc_id, r.pattern_id): r.n_matches for r in search.count(df, table, ci).collect()}
    assert got == {key: len(at) for key, at in want.items()}
    few = df.where("doc_id != 50 or doc_id is null")
    some = table.where("octet_length(pattern) > 2")
    found = {}
    for r in search.locate(few, some, ci).collect():
        found.setdefault((r.doc_id, r.pattern_id), []).append(r.pos)
    assert {key: sorted(at) for key, at in found.items()} == {(i, k): at for (i, k), at in want.items() if i != 50 and len(patterns[k][1]) > 2}
    assert {(r.doc_id, r.pattern_id) for r in search.contains(df, table, ci).collect()} == set(want)
    held = {i for i, k in want if len(patterns[k][1]) > 2}
    assert {r.doc_id for r in search.contains(df, some, ci, how="semi").collect()} == held
    assert {r.doc_id for r in search.contains(df, some, ci, how="anti").collect()} == {i for i, _ in docs} - held
    totals = {r.pattern_id: r.n_matches for r in search.total_counts(df, table, ci).collect()}
    assert totals == {k: sum(len(at) for (_, j), at in want.items() if j == k) for k in {k for _, k in want}}


def test_table_agrees_with_the_automaton_and_texts_are_read_once(spark):
    docs, patterns = texts_and_patterns()
    df = spark.createDataFrame(docs[:30], DOCS)
    stated = dict(patterns)
    rows = lambda found: sorted(map(tuple, found.collect()))
    table = spark.createDataFrame(patterns, "id long, pattern binary")
    assert rows(search.count(df, stated).select("doc_id", "pattern_id", "n_matches")) == rows(search.count(df, table).select("doc_id", "pattern_id", "n_matches"))
    # Patterns longer than what a window carries are held against the texts: those are read again for them.
    short = table.where("octet_length(pattern) <= 128")
    plan = search.count(df, short)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_large_stated_sets_become_tables(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_PATTERNS", 3)
    df = spark.createDataFrame([(1, b"one two"), (2, b"two")], DOCS)
    assert sorted(map(tuple, search.count(df, ["one", "two", "o", "", "none"]).collect())) == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 8), (2, 1, 1), (2, 2, 1), (2, 3, 4)]
    named = search.count(df, {"a": "one", "b": "two", "c": "o", "d": "w"})
    assert sorted(map(tuple, named.collect())) == [(1, "a", 1), (1, "b", 1), (1, "c", 2), (1, "d", 1), (2, "b", 1), (2, "c", 1), (2, "d", 1)]


def test_empty_tables_and_ids_of_any_type(spark):
    df = spark.createDataFrame([(1, b"one two")], DOCS)
    none = spark.createDataFrame([], "id string, pattern string")
    assert search.count(df, none).count() == 0 and search.locate(df, none).count() == 0
    assert search.contains(df, none, how="anti").count() == 1 and search.contains(df, none, how="semi").count() == 0
    named = spark.createDataFrame([("a", "two"), (None, "one"), ("a", "one")], "id string, pattern string")
    assert sorted(map(str, map(tuple, search.count(df, named).collect()))) == sorted(map(str, [(1, "a", 2), (1, None, 1)]))
    assert search.count(df.limit(0), named).count() == 0


def test_hashes_by_doubling_are_polynomials():
    data = np.random.default_rng(1).integers(0, 256, 200).astype(np.uint8)
    mixed = windows.window_hashes(data, [1, 8, 64])
    seen = {}
    for size, h in mixed.items():
        assert len(h) == 200 - size + 1
        for k, x in enumerate(h.tolist()):
            assert seen.setdefault((size, bytes(data[k : k + size])), x) == x
    assert len(set(seen.values())) == len(seen)
    assert set(windows.window_hashes(data[:3], [0, 2, 4])) == {0, 2}


def test_short_texts_are_hashed_together():
    """A batch of short texts took a hash of its own for each; windows never span two texts."""
    import numpy as np
    import pyarrow as pa

    from bytelode.operators import windows

    texts = [b"ab", b"", b"abab", b"b", b"aab" * 3, b"a"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["key", "text"])

    class Sent:
        value = np.full(1 << 10, -1, np.int64).view(np.uint64)  # a filter that lets all pass

    calls, real = [], windows.window_hashes
    windows.window_hashes = lambda data, sizes: calls.append(1) or real(data, sizes)
    try:
        for places in (True, False):
            calls.clear()
            got = {}
            for out in windows._window_batches({0: 0, 2: 3}, 1 << 16, Sent, places, False)([batch]):
                for key, _, cells, value in zip(*(c.to_pylist() for c in out.columns)):
                    got.setdefault(key, []).append((cells, value))
            assert len(calls) == 1
            for i, t in enumerate(texts):
                at = [((t[k : k + 3] + b"\0\0\0")[:3], k) for k in range(len(t) - 1)]
                counted = [(c, sum(c == d for d, _ in at)) for c in {c for c, _ in at}] + [(b"", len(t) + 1)]
                assert sorted(got[i]) == sorted(at + [(b"", k) for k in range(len(t) + 1)] if places else counted)
    finally:
        windows.window_hashes = real
