import random

import numpy as np
import pytest

from bytelode.llm import nearcopies
from bytelode.llm.common import Scratch
from bytelode.llm.nearcopies import band_keys, keep_one_of_each, near, print_links, similarity, wide_print
from bytelode.llm.simhash import shingle_hashes
from tests.llm.test_simhash import plain_components


def hashes(text):
    return np.unique(np.frombuffer(shingle_hashes(text.encode(), 5), ">u8").astype(np.uint64))


def jaccard(a, b):
    x, y = set(hashes(a).tolist()), set(hashes(b).tolist())
    return len(x & y) / len(x | y)


def edited(rng, words, share):
    """A text and a copy in which about one word in `share` is another."""
    text = [rng.choice(words) for _ in range(rng.randint(150, 500))]
    return " ".join(text), " ".join(rng.choice(words) if rng.random() < 1 / share else w for w in text)


def bits(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(*([v % 2**64 for v in wide_print(hashes(t))] for t in (a, b))))


def test_bits_follow_the_similarity_and_keys_meet():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    pairs = [edited(rng, words, share) for share in (50, 60, 80, 120, 200) for _ in range(60)]
    alike = [(a, b) for a, b in pairs if jaccard(a, b) >= 0.8]
    very = [(a, b) for a, b in alike if jaccard(a, b) >= 0.88]
    assert len(alike) > 100 and len(very) > 60
    assert all(set(band_keys(hashes(a)).tolist()) & set(band_keys(hashes(b)).tolist()) for a, b in alike)
    assert sum(bits(a, b) <= nearcopies.TAU for a, b in alike) > 0.97 * len(alike)
    assert all(bits(a, b) <= nearcopies.TAU for a, b in very)
    far = [edited(rng, words, 6) for _ in range(60)]
    assert all(jaccard(a, b) < 0.6 for a, b in far) and not any(bits(a, b) <= nearcopies.TAU for a, b in far)
    assert wide_print(hashes("")) == [0, 0, 0, 0] and len(set(band_keys(hashes("one two")).tolist())) == nearcopies.BANDS


def test_chains_prune_nothing_that_links():
    rng = np.random.default_rng(4)
    differ = np.zeros((4000, 4), np.uint64)
    for i in range(len(differ)):
        low = rng.integers(0, 256) if i % 2 else 0
        for bit in rng.choice(256, rng.integers(0, 70), replace=False) if i % 4 else (low + np.arange(rng.integers(0, 60))) % 256:
            differ[i, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    assert (near(differ) == (np.bitwise_count(differ).sum(axis=1) <= nearcopies.TAU)).all()


@pytest.mark.parametrize("small, block", [(16, 8192), (2, 8192), (4, 15)])
def test_links_join_what_meets_and_is_near(spark, monkeypatch, small, block):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows, node = [], 0
    for key, size in ((1, 60), (2, 9), (3, 2), (4, 1)):
        base = rng.integers(0, 2, 256)
        for _ in range(size):
            flipped = base.copy()
            flipped[rng.choice(256, rng.integers(0, 40), replace=False)] ^= 1
            words = np.packbits(flipped).view(np.uint64)
            rows.append((node, *(int(w) for w in words.view(np.int64)), [key, 100 + node % 7, 1000 + node]))
            node += 1
    schema = "node long, w0 long, w1 long, w2 long, w3 long, keys array<long>"
    edges = [(r.a, r.b) for r in print_links(spark.createDataFrame(rows, schema).repartition(3), Scratch(spark)).collect()]
    distance = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(rows[a][1:5], rows[b][1:5]))
    linked = lambda a, b: bool(set(rows[a][5]) & set(rows[b][5])) and distance(a, b) <= nearcopies.TAU
    assert all(linked(a, b) for a, b in edges)
    found = {frozenset(e) for e in edges}
    assert plain_components(range(node), lambda a, b: frozenset((a, b)) in found) == plain_components(range(node), linked)


def shingle_sets(texts):
    out = {}
    for i, text in texts.items():
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        out[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def exact_kept(texts):
    """The smallest id of each group that exact similarities of 0.8 link."""
    sets = shingle_sets(texts)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return set(plain_components(sorted(texts), alike).values())


def stage(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in keep_one_of_each(spark, rows, "").collect()}


def families(rng, n, size, shares=(40, 60, 90)):
    """Texts and their edited copies, some above and some below 0.8, and a passage that many share."""
    words = [f"w{i}" for i in range(2000)]
    shared, texts = " ".join(rng.choice(words) for _ in range(60)), {}
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, size)):
            share = rng.choice(shares)
            copy = [rng.choice(words) if rng.random() < 1 / share else w for w in base]
            texts[len(texts)] = " ".join(copy + [shared] * (rng.random() < 0.2))
    return texts


@pytest.mark.parametrize("small, block", [(16, 8192), (3, 8192), (3, 8)])
def test_stage_keeps_what_exact_similarities_leave(spark, monkeypatch, small, block):
    """Also with buckets so small that forests and the second round have to find the links."""
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = families(random.Random(small + block), 6, 50)
    texts |= {5000: None, 5001: "", 5002: " \n", 5003: "x " * 30_000, 5004: "X " * 30_000, 5005: "one two", 5006: "one two three", 5007: "One TWO"}
    assert stage(spark, texts) == exact_kept(texts)


def test_recall_over_planted_pairs(spark):
    """All pairs from 0.8 on link, as good as all; no document goes that is no copy."""
    rng, words, texts = random.Random(9), [f"w{i}" for i in range(5000)], {}
    sets = {}
    for i in range(1100):
        base = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        copy = [rng.choice(words) if rng.random() < 1 / 45 else w for w in base]
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(copy)
    sets, kept = shingle_sets(texts), stage(spark, texts)
    share = {i: len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(1100)}
    alike = [i for i, x in share.items() if x >= 0.8]
    found = [i for i in alike if 2 * i + 1 not in kept]
    assert len(alike) > 500 and len(found) >= 0.97 * len(alike)
    assert all(2 * i in kept for i in share) and all(2 * i + 1 in kept for i, x in share.items() if x < 0.8)
    assert similarity(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1.0


def test_stage_on_the_given_documents(spark):
    pq = pytest.importorskip("pyarrow.parquet")
    try:
        rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    except FileNotFoundError:
        pytest.skip("the driver's tables aren't here")
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert stage(spark, texts) == exact_kept(texts)
