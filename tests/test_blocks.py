import random

import pytest

from bytelode.operators.corpusorder import suffix_ranges, with_ranks
from bytelode.operators.index import build_corpus_index, corpus_suffixes, suffix_array
from bytelode.session import Scratch
from bytelode.sources.blocks import BlockTexts, cut_texts, join_chunks

DOCS = "doc_id long, text binary"
PATTERNS = [b"", b"a", b"ab", b"aa", b"abaab", b"\0", b"zz", b"abababababab"]


def places(text, pattern):
    return [k for k in range(len(text) - len(pattern) + 1) if text[k : k + len(pattern)] == pattern] if b"\0" not in pattern else []


def texts():
    rng = random.Random(11)
    out = {i: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for i in range(12)}
    return out | {20: b"", 21: b"ab" * 20, 22: b"ab" * 20, 23: b"a" * 33, 24: b"x\0y\xff\xfe" * 3}


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_searches_over_blocks_are_those_of_the_whole_texts(spark, size):
    own = texts()
    docs = spark.createDataFrame([*own.items(), (30, None)], DOCS)
    blocks = BlockTexts(cut_texts(docs, size=size), size)
    want = {(i, k): places(t, p) for i, t in own.items() for k, p in enumerate(PATTERNS)}
    want = {key: at for key, at in want.items() if at}
    assert {(r.id, r.pattern_id): r.n_matches for r in blocks.count(PATTERNS).collect()} == {key: len(at) for key, at in want.items()}
    found = {}
    for r in blocks.locate(PATTERNS).collect():
        found.setdefault((r.id, r.pattern_id), []).append(r.pos)
    assert {key: sorted(at) for key, at in found.items()} == want
    table = spark.createDataFrame(list(enumerate(PATTERNS)), "k long, p binary")
    assert {(r.id, r.pattern_id) for r in blocks.contains(table).collect()} == set(want)
    assert {r.id: r.text_len for r in blocks.lengths().collect()} == {i: len(t) for i, t in own.items()}


def test_chunks_become_blocks(spark):
    rng = random.Random(2)
    rows, whole = [], {}
    for i in range(8):
        parts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 3, 9, 30]))) for _ in range(rng.randint(1, 7))]
        rows += [(i, k, p) for k, p in enumerate(parts)]
        whole[i] = b"".join(parts)
    rows += [(9, 1, b"same"), (9, 1, b"same"), (9, 0, None), (10, 0, None), (11, 0, b"12345678"), (11, 1, b"")]
    whole |= {9: b"samesame", 10: b"", 11: b"12345678"}
    rng.shuffle(rows)
    got = {}
    for r in join_chunks(spark.createDataFrame(rows, "doc_id long, seq long, chunk binary").repartition(3), size=8).collect():
        got.setdefault(r.id, {})[r.block] = bytes(r.data)
    assert {i: b"".join(b[k] for k in range(len(b))) for i, b in got.items()} == whole
    assert all(len(b[k]) == 8 for b in got.values() for k in range(len(b) - 1)) and list(got[11]) == [0]


def test_suffixes_from_blocks_and_of_the_corpus(spark, tmp_path):
    own = {i: t for i, t in texts().items() if i > 7}
    docs = spark.createDataFrame(list(own.items()), DOCS)
    found = {}
    for r in suffix_array(docs, kernel_bytes=4).collect():
        found.setdefault(r.doc_id, {})[r.sa_rank] = r.pos
    assert {i: [x[k] for k in range(len(x))] for i, x in found.items()} == {i: sorted(range(len(t) + 1), key=lambda k: t[k:]) for i, t in own.items()}
    blocks = cut_texts(docs, size=6)
    order = sorted((t[k:], i, k) for i, t in own.items() for k in range(len(t) + 1))
    rows = sorted((r.rank, r.id, r.pos, r.bwt_byte) for r in corpus_suffixes(blocks, 6, Scratch(spark).write).collect())
    assert rows == [(n, i, k, own[i][k - 1] if k else None) for n, (_, i, k) in enumerate(order)]
    index = build_corpus_index(blocks, f"{tmp_path}/corpus", 6)
    asked = [*PATTERNS, b"abababababababababab", b"abababababababababaa"]
    ranges = {r.pattern_id: (r.sp, r.ep) for r in index.search_range(asked).collect()}
    for k, p in enumerate(asked):
        at = [n for n, (s, _, _) in enumerate(order) if s.startswith(p)] if b"\0" not in p else []
        assert ranges.get(k, (0, 0)) == ((at[0], at[-1] + 1) if at else (0, 0))
    assert {(r.id, r.pos) for r in index.locate([b"abaab"]).collect()} == {(i, k) for s, i, k in order if s.startswith(b"abaab")}


def order_of(own):
    return [(i, k, own[i][k - 1] if k else None, own[i][k : k + 8]) for _, i, k in sorted((t[k:], i, k) for i, t in own.items() for k in range(len(t) + 1))]


@pytest.mark.parametrize("size", [5, 64, 70, 100_000])
def test_corpus_order_in_ranges(spark, size):
    rng = random.Random(size)
    word = lambda n, letters=b"ab": bytes(rng.choice(letters) for _ in range(n))
    whole, zeros = word(700, b"the on"), word(200, b"\0\x01")
    own = {f"k{i:02}": word(i) for i in range(18, 32)} | {"b": whole, "a": whole, "c": whole[:430], "d": whole[3:], "e": word(9) + whole[:500] + b"\xff", "f": whole[:300] + whole[301:]}
    own |= {"p": b"a" * 300, "q": b"a" * 301, "r": b"ab" * 128, "s": b"\0" * 150, "t": zeros, "u": zeros + b"\0", "v": b"", "w": b"", "x": whole[:64], "y": whole[:128], "z": whole[:24]}
    blocks = cut_texts(spark.createDataFrame(list(own.items()), "doc_id string, text binary").repartition(3), size=size)
    scratch = Scratch(spark)
    ranges = scratch.write(suffix_ranges(blocks, size, scratch.write, suffixes=100))
    rows = with_ranks(ranges).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(len(rows))) and len({r.part for r in rows}) > 20
    assert [(r.id, r.pos, r.bwt_byte, bytes(r.key8)) for r in rows] == order_of(own)


def test_corpus_order_of_nothing(spark, tmp_path):
    blocks = cut_texts(spark.createDataFrame([(1, None)], DOCS), size=64)
    assert {(r.sp, r.ep) for r in build_corpus_index(blocks, f"{tmp_path}/none", 64).search_range([b"a", b""]).collect()} == {(0, 0)}


def test_a_suffix_moves_once(spark):
    """What building the order stores for later steps, in rows and copies of texts included: less than a row for each suffix but for the order itself."""
    rng = random.Random(5)
    words = [bytes(rng.choice(b"etaoinshr") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    own = {i: b" ".join(rng.choice(words) for _ in range(150)) for i in range(20)}
    own |= {100 + i: own[i] for i in range(5)}
    scratch, stored = Scratch(spark), []

    def save(df):
        stored.append(scratch.write(df))
        return stored[-1]

    found = corpus_suffixes(cut_texts(spark.createDataFrame(list(own.items()), DOCS), size=256), 256, save)
    n = sum(len(t) + 1 for t in own.values())
    assert found.count() == n
    assert sum(t.count() for t in stored) < 3 * n
