import random

import pytest

from bytelode.functions import fnv1a64
from bytelode.functions.sql import register
from bytelode.operators import search
from bytelode.plans import patterns as plans
from bytelode.plans.patterns import pattern_list, successor
from pyspark.sql import functions as F

THE = b"the quick brown fox jumps over the lazy dog " * 100


def places(text, pattern):
    if b"\0" in pattern:
        return []
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


def fold(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


# Cases with fixed results.
COUNTS = [
    (b"abracadabra", {b"abra": 2, b"bra": 2, b"a": 5, b"xyz": 0, b"b": 2, b"r": 2, b"c": 1, b"d": 1, b"z": 0}),
    (b"hello", {b"": 6, b"he": 1, b"hello": 1}),
    (b"exactmatch", {b"exactmatch": 1}),
    (b"aaaaaaaaaa", {b"a": 10, b"aa": 9, b"aaa": 8, b"a" * 11: 0}),
    (b"line one\nline two\nline three", {b"line": 3, b"\n": 2}),
    (b"abababab", {b"ab": 4}),
    (b"mississippi", {b"issi": 2, b"mississippi": 1, b"is": 2, b"ss": 2, b"p": 2, b"ippi": 1}),
    (THE, {b"the": 200, b"fox": 100, b"xyz": 0}),
    (b"", {b"a": 0, b"": 1}),
    (b"hi", {b"hello": 0}),
    (bytes(range(1, 51)), {b"\x01": 1, b"\x31": 1}),
]


@pytest.mark.parametrize("few", [8, 0])
def test_fixed_counts(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    docs = spark.createDataFrame([(i, bytearray(t)) for i, (t, _) in enumerate(COUNTS)], "doc_id long, text binary")
    patterns = sorted({p for _, e in COUNTS for p in e})
    for at in range(0, len(patterns), 8):
        part = dict(enumerate(patterns[at : at + 8]))
        got = {(r.doc_id, part[r.pattern_id]): r.n_matches for r in search.count(docs, part).collect()}
        for i, (_, expected) in enumerate(COUNTS):
            for p, n in expected.items():
                if p in part.values():
                    assert got.get((i, p), 0) == n, (i, p)


@pytest.mark.parametrize("few", [100, 0])
def test_random_bytes_against_a_byte_loop(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    rng = random.Random(few)
    alphabet = [0, 0x41, 0x42, 0x61, 0x62, 0xC3, 0xFF, 0x5C, 0x45, 0x51, 0x0A]
    make = lambda n: bytes(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    texts = [make(40) for _ in range(60)] + [b"\\Ea\\E", b"aB" * 2000]
    patterns = [b"", b"\0", b"a\0", b"\\E", b"aa", b"\xff", "é".encode()] + [make(3) for _ in range(20)]
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text binary").repartition(3)
    for ci in (False, True):
        want = {}
        for i, t in enumerate(texts):
            for k, p in enumerate(patterns):
                at = places(fold(t) if ci else t, fold(p) if ci else p)
                if at:
                    want[i, k] = at
        assert {(r.doc_id, r.pattern_id): r.n_matches for r in search.count(docs, patterns, ci).collect()} == {k: len(v) for k, v in want.items()}
        assert {(r.doc_id, r.pattern_id): r.positions for r in search.locate_all(docs, patterns, ci).collect()} == want
        assert {(r.doc_id, r.pattern_id) for r in search.contains(docs, patterns, ci).collect()} == set(want)
        some = patterns[8:12]
        holding = {i for i, t in enumerate(texts) if any(places(fold(t) if ci else t, fold(p) if ci else p) for p in some)}
        assert {r.doc_id for r in search.contains(docs, some, ci, "semi").collect()} == holding
        assert {r.doc_id for r in search.contains(docs, some, ci, "anti").collect()} == set(range(len(texts))) - holding | {99}


def test_ascii_folding_only(spark):
    docs = spark.createDataFrame([(1, "Hello World HELLO world"), (2, "abABab"), (3, "café É")], "doc_id long, text string")
    got = {(r.doc_id, r.pattern_id): r.n_matches for r in search.count(docs, ["HELLO", "WORLD", "ab", "caf", "é"], ci=True).collect()}
    assert got == {(1, 0): 2, (1, 1): 2, (2, 2): 3, (3, 3): 1, (3, 4): 1}
    assert [r.positions for r in search.locate_all(docs, ["ab"], ci=True).collect()] == [[0, 2, 4]]
    five = "日本語の字"
    assert search.count(spark.createDataFrame([(1, five)], "doc_id long, text string"), [""]).first().n_matches == 16


def test_pattern_sets(spark):
    df = spark.createDataFrame([(7, "B"), (8, None)], "id long, p string")
    assert pattern_list(df) == [(7, b"B")] and pattern_list({3: b"x"}) == [(3, b"x")] and pattern_list(["É"], ci=True) == [(0, "É".encode())]
    assert successor(b"ab") == b"ac" and successor(b"a\xff\xff") == b"b" and successor(b"\xff") is None
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert search.count(docs, []).count() == 0 and search.locate(docs, []).count() == 0 and search.contains(docs, []).count() == 0
    assert search.contains(docs, [], how="anti").count() == 1 and search.count(docs.limit(0), ["a"]).count() == 0
    assert search.text_lengths(docs).first().text_len == 2


def test_total_counts(spark):
    docs = spark.createDataFrame([(1, "en", "aab"), (2, "en", "b"), (3, "fr", "a")], "doc_id long, lang string, text string")
    assert {tuple(r) for r in search.total_counts(docs, ["a", "b"], by=["lang"]).collect()} == {("en", 0, 2), ("en", 1, 2), ("fr", 0, 1)}
    assert {tuple(r) for r in search.total_counts(docs, ["a"]).collect()} == {(0, 3)}


def test_fnv(spark):
    known = {"": 0xCBF29CE484222325, "test": 0xF9E6E6EF197C2B25, "tset": 0x50D090EF4ACBCC21, "hello": 0xA430D84680AABD0B}
    got = spark.createDataFrame([(k,) for k in known], "p string").select("p", fnv1a64(F.col("p")).alias("h")).collect()
    assert {r.p: r.h % 2**64 for r in got} == known


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select bytes_count('abracadabra', 'abra') a, bytes_count('hello', '') b, bytes_count('x', X'00') c, bytes_contains('abc', 'd') d, bytes_count_ci('aAé', 'A') e, bytes_contains_ci('É', 'é') f, bytes_index_size('abcdefghijk', 1) g, bytes_index_size('', 4) h, bytes_index_ratio('', 4) i, bytes_text_len('é') j, bytes_count(null, 'a') k, bytes_sample_step(0) l").first()
    assert tuple(row) == (2, 6, 0, False, 2, False, 2320, 2136, 0.0, 2, None, 1)


def test_locate_in_sql(spark):
    register(spark)
    cases = [("abracadabra", "abra"), ("aaaa", "aa"), ("é é", "é"), ("", ""), ("ab", ""), ("ab", "abc"), ("xAbab", "AB"), ("x", "y")]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(cases)] + [(98, None, "a"), (99, "a", None)], "i long, t string, p string")
    got = {r.i: (r.a, r.b) for r in df.selectExpr("i", "bytes_locate(t, p) a", "bytes_locate_ci(t, p) b").collect()}
    for i, (t, p) in enumerate(cases):
        assert got[i] == (places(t.encode(), p.encode()), places(fold(t.encode()), fold(p.encode())))
    assert got[98] == got[99] == (None, None)
    assert spark.sql("select bytes_locate(X'610061', X'00') a, bytes_locate(X'FFFF', X'FF') b").first()[:] == ([], [0, 1])


def test_query_sets_in_parts_and_named_patterns(spark, monkeypatch):
    monkeypatch.setattr(plans, "MOST_PATTERNS", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(60)) for _ in range(20)]
    patterns = {f"name {p!r}": p for p in {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(60)}}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(i, n): places(t.encode(), p.encode()) for i, t in enumerate(texts) for n, p in patterns.items() if p in t}
    table = spark.createDataFrame(list(patterns.items()), "name string, p string")
    for given in (patterns, table):
        assert {(r.doc_id, r.pattern_id): r.n_matches for r in search.count(docs, given).collect()} == {k: len(v) for k, v in want.items()}
        assert {(r.doc_id, r.pattern_id): r.positions for r in search.locate_all(docs, given).collect()} == want
        assert {tuple(r) for r in search.contains(docs, given).collect()} == set(want)
    few = dict(list(patterns.items())[:3])
    assert {(r.doc_id, r.pattern_id): r.n_matches for r in search.count(docs, few).collect()} == {k: len(v) for k, v in want.items() if k[1] in few}
    rare = [p for p in patterns.values() if len(p) == 3][:20]
    holding = {i for i, t in enumerate(texts) if any(p in t for p in rare)}
    assert {r.doc_id for r in search.contains(docs, rare, how="semi").collect()} == holding
    assert {r.doc_id for r in search.contains(docs, rare, how="anti").collect()} == set(range(20)) - holding


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "ab", 5, 6, 7)], "doc_id long, text string, _key long, m long, pattern_id long")
    assert [tuple(r) for r in search.total_counts(docs, ["a"], by=["_key", "m"]).collect()] == [(5, 6, 0, 1)]
    assert search.contains(docs, ["a"], how="semi").columns == docs.columns and search.count(docs, ["b"]).count() == 1


def test_strings_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"a\xffb a\xff")), (2, bytearray("é".encode()))], "doc_id long, b binary").select("doc_id", F.expr("cast(b as string)").alias("text"))
    for patterns in (["a", "b", "é"], [*"abcdefghij", "é"]):
        got = {(r.doc_id, patterns[r.pattern_id]): r.n_matches for r in search.count(docs, patterns).collect()}
        assert got == {(1, "a"): 2, (1, "b"): 1, (2, "é"): 1}
    assert {tuple(r) for r in search.locate(docs, [b"\xff"]).collect()} == {(1, 0, 1), (1, 0, 5)}
    assert search.contains(docs, ["x"] * 9 + ["a"], how="semi").count() == 1


def test_locate_of_few_patterns_is_an_expression(spark):
    """More places than one run adds up, patterns with and without borders, quoting, bytes 0 and bytes that are no UTF-8."""
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab\\E") for _ in range(n)) for n in (0, 1, 7, 300, 2000)] + [b"ab" * 70_000, b"a" * 3000, b"\xff\x00\xffab\x00\xc3", "éaéb\n".encode()]
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text binary")
    patterns = [b"ab", b"a", b"aba", b"\\E", b"\xff", b"", b"\x00", b"b\n"]
    found = search.locate(docs, patterns)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    want = {(i, k, at) for i, t in enumerate(texts) for k, p in enumerate(patterns) for at in places(t, p)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    register(spark)
    for k, p in enumerate(patterns):
        held = spark.sql(f"select doc_id, bytes_locate(text, X'{p.hex()}') at from {{docs}}", docs=docs).collect()
        assert {r.doc_id: r.at for r in held} == {i: places(t, p) for i, t in enumerate(texts)} | {99: None}
