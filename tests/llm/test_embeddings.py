import math

import numpy as np

from bytelode.llm import embeddings
from bytelode.llm.embeddings import CapFilters, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, v int"


def rows():
    rng = np.random.default_rng(3)
    out, i = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=24)
            for k in range(rng.integers(1, 6)):
                v = base + rng.normal(size=24) * 0.03 * k * np.linalg.norm(base) / 5
                out.append((i, v, label if k != 4 else (label + 1) % 3))
                i += 1
    same = rng.normal(size=24)
    out += [(i + k, same, 1) for k in range(30)] + [(i + 30, 2 * same, 1), (i + 31, same, None), (i + 32, np.zeros(24), 1), (i + 33, np.full(24, np.nan), 1), (i + 34, np.full(24, np.inf), 1), (i + 35, np.ones(3), 1), (i + 36, np.ones(3) * 5, 1), (i + 36, np.ones(3) * 5, 1)]
    return [(int(a), [float(x) for x in np.float32(v)], b) for a, v, b in out] + [(5000, None, 1), (5001, [1.0, None], 1), (5002, [], 1), (5003, [-0.0, 1.0], 0), (5004, [0.0, 1.0], 0)]


def plain(data):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    parent, links = list(range(len(data))), [0] * len(data)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, la) in enumerate(data):
        for j, (_, b, lb) in enumerate(data[:i]):
            if la == lb and usable(a, la) and usable(b, lb) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (v, *_) in enumerate(data):
        least[find(i)] = min(v, least.get(find(i), v))
    return sorted((v, links[i], least[find(i)], least[find(i)] == v) for i, (v, *_) in enumerate(data))


def test_links_and_components_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in data], SCHEMA).repartition(4)
    assert sorted(map(tuple, near_vectors(df).collect())) == plain(data)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, "", 0), (4, [1.0, 2.0], 1, "", 0), (None, None, 1, "", 0)], SCHEMA)
    assert sorted(map(str, map(tuple, near_vectors(df).collect()))) == sorted(map(str, [(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, False)]))
    assert near_vectors(df.limit(0)).count() == 0


def test_clusters_of_near_vectors_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SMALL", 6)
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    rng = np.random.default_rng(8)
    data, i = [], 0
    for size, spread in ((150, 0.14), (40, 0.13), (9, 0.1), (5, 0.1)):
        base = rng.normal(size=24)
        for _ in range(size):
            data.append((i, [float(x) for x in np.float32(base + rng.normal(size=24) * spread * np.linalg.norm(base) / 5)], 1))
            i += 1
    data += [(i + k, data[3][1], 1) for k in range(4)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in data], SCHEMA).repartition(4)
    want = plain(data)
    assert sorted(map(tuple, near_vectors(df).collect())) == want
    assert len({n for _, n, _, _ in want}) > 20  # neither all linked nor none


def test_filters_are_shared_and_few():
    rng = np.random.default_rng(1)
    for dim in (24, 64, 768):
        for rows in (10_000, 1_000_000):
            filters = CapFilters(dim, rows)
            a = rng.normal(size=(40, dim))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            side = rng.normal(size=(40, dim))
            side -= (side * a).sum(axis=1, keepdims=True) * a
            b = 0.98 * a + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
            passed = [filters.decode(x) for x in (a, b)]
            assert all(set(x) & set(y) for x, y in zip(*passed)), (dim, rows)
            assert all(len(set(x)) == len(x) >= 16 for x in passed[0]) and np.mean([len(x) for x in passed[0]]) < 60
            assert (np.bitwise_count((filters.signs(a) ^ filters.signs(b)).view(np.uint64)).sum(axis=1) <= filters.most_bits).all()
