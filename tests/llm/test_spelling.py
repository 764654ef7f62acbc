import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from bytelode.llm import spelling
from bytelode.llm.common import Scratch
from bytelode.llm.spelling import Shard, frequent_words, near_words, one_edit, op11_spelling_variants, variants

WORDS = "word string, n long"


def edits(a, b):
    """Levenshtein distance by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(counts, ratio=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(w, v) == 1] for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= ratio * counts[w] else None for w, f in form.items()}
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def vocabulary(rng, letters, n):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)]
    out = set(base)
    for w in base:
        for _ in range(3):
            k = rng.randrange(len(w))
            out.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return {w: rng.choice([5, 6, 30, 200, 1001, 5005]) for w in out if len(w) >= 2}


@pytest.mark.parametrize("letters, n, shard, block", [("abcdeéÿ", 60, 20_000, 50_000), ("ab", 40, 30, 50_000), ("abcd", 60, 25, 6)])
def test_forms_and_roots_are_those_of_all_pairs(spark, monkeypatch, letters, n, shard, block):
    """Also where halves are so common that they are dealt to blocks."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "BLOCK", block)
    counts = vocabulary(random.Random(n + shard), letters, n) | {"a" * 40_000: 9, "a" * 39_999: 90, "a" * 39_998 + "b": 5}
    counts = {w: m for w, m in counts.items() if len(w) < 100 or shard > 100}
    words = spark.createDataFrame(list(counts.items()), WORDS).repartition(3)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(words, Scratch(spark)).collect()}
    short = {w: m for w, m in counts.items() if len(w) < 100}
    want = plain(short)
    if len(short) < len(counts):
        a, b, c = "a" * 40_000, "a" * 39_999, "a" * 39_998 + "b"
        want |= {(a, b, b, 9, 1, 90), (b, None, b, 90, 2, None), (c, b, b, 5, 1, 90)}
    assert got == want


def test_edits_and_shards_by_hand():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    assert all(one_edit(a, b) == (edits(a, b) == 1) for a in words for b in words)
    shard = Shard()
    for w in set(words):
        shard.hold(0, w, 1)
        shard.hold(1, w, 1)
    for w in words:
        found = [v for v, _ in shard.near(w)]
        assert sorted(found) == sorted(v for v in set(words) if edits(w, v) == 1)


def documents():
    rng = random.Random(5)
    words = ["Schöner", "colour", "color", "colours", "thing", "Ünique", "unique", "HELLOWORLD", "a×b÷cde"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "x") for i in range(120)]
    return [*rows, (7, rows[7][1], "x"), (200, None, "x"), (201, "", "y"), (202, "x" * 100_000, "x"), (None, "colour " * 9, "x")]


def test_words_are_damaged_as_the_checksum_says(spark, tmp_path):
    df = spark.createDataFrame(documents(), "doc_id long, text string, word string").repartition(3)
    want = Counter()
    for i, text, _ in documents():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in frequent_words(df).collect()} == want and len(want) > 5
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in op11_spelling_variants(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(f"select word, form, root, n, n_near, form_n from ({spelling.OP11_SQL})").fetchall()) == plain(want)


def test_bytes_that_are_no_text_and_empty_tables(spark):
    df = spark.createDataFrame([(1, bytearray(b"colour\xffcolour " * 4))], "doc_id long, text binary")
    assert {r.word: r.n for r in frequent_words(df).collect()}["colour"] >= 5
    none = frequent_words(df.limit(0))
    assert none.count() == 0 and variants(none, Scratch(spark)).count() == 0 and near_words(none, Scratch(spark)).count() == 0
