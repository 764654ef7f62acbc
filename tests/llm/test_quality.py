import random

import numpy as np
from pyspark.sql import functions as F

from bytelode.llm import quality
from bytelode.llm.common import may_learn
from bytelode.llm.quality import STATISTICS, RuleEnsemble, fit, learn, score, statistics, statistics_of

SCHEMA = "doc_id long, text string, score double, quality int"


def rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "été"]
    out = []
    for i in range(400):
        good = i % 4 != 0
        w = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        out.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), 0.5, int(good)))
    return out


def test_statistics_of_whole_texts():
    s = dict(zip(STATISTICS, statistics("Ab Ab ab!\nx|1 é".encode())))
    assert s["n_words"] == 5 and s["n_bytes"] == 16 and s["repeated_next"] == 1 / 5 and s["distinct_words"] == 4 / 5
    assert s["bars"] == 1 / 5 and s["exclamations"] == 1 / 5 and s["non_ascii_share"] == 2 / 16 and s["line_words"] == 2.5
    assert statistics(None) == statistics(b"") and all(np.isfinite(statistics(b"")))


def test_learns_rules_and_spark_agrees_with_them(spark):
    data = rows()
    docs, labels = spark.createDataFrame([(i, t, s, 9) for i, t, s, _ in data], SCHEMA), spark.createDataFrame([(i, q) for i, _, _, q in data] + [(0, None), (5, 1), (None, 1)], "doc_id long, quality int")
    model = learn(docs.repartition(3), labels)
    assert 0 < len(model.rules) < 60
    got = score(docs, model).collect()
    truth = {i: q for i, _, _, q in data}
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.predicted == truth[r.doc_id] for r in held)
    want = {i: s for (i, *_), s in zip(data, model.score(np.array([statistics(t.encode()) for _, t, _, _ in data])))}
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    flipped = labels.withColumn("quality", F.when(may_learn(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    assert learn(docs, flipped) == model


def test_null_empty_long_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.0, 0), (1, None, 0.0, 0), (2, "", 0.0, 0), (None, "word " * 50_000, 0.0, 0)], SCHEMA)
    model = learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = score(docs, model).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    assert score(docs.limit(0), model).count() == 0
    assert fit(np.zeros((40, len(STATISTICS))), np.ones(40)).rules == []
    assert RuleEnsemble(0.0).score(np.zeros((1, len(STATISTICS))))[0] == 0.5
    assert docs.select(statistics_of(F.col("text")).alias("s")).select("s.n_words").count() == 4


def plain_nodes(x, y, rows, path):
    """All nodes of the greedy tree of depth 3, each found by trying every cut of every statistic."""
    found = [path] if path else []
    best = (1e-9, None)
    gradient, weight = y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    score = lambda m: gradient[m].sum() ** 2 / (weight[m].sum() + 1)
    if len(path) < 3:
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])):
                low, high = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                if min(low.sum(), high.sum()) < 10:
                    continue
                gain = score(low) + score(high) - score(rows)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
    if best[1] is not None:
        f, cut = best[1]
        for above, part in ((False, rows & (x[:, f] <= cut)), (True, rows & (x[:, f] > cut))):
            found += plain_nodes(x, y, part, tuple(sorted({*path, (f, above, float(cut))})))
    return found


def test_tree_paths_are_those_of_every_cut_tried():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 0.8) | (x[:, 0] > 1.4)).astype(float)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 33)[1:-1])) for i in range(4)]
    codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1)
    grown = set()
    quality._grow(codes, cuts, y - y.mean(), np.full(300, y.mean() * (1 - y.mean())), np.arange(300), np.arange(4), (), grown)
    assert grown == set(plain_nodes(x, y, np.ones(300, bool), ())) and len(grown) > 6


def test_lasso_weights_are_optimal():
    """At the minimum a kept rule's gradient is the penalty and any other's is no larger."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(STATISTICS)))
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * (x[:, 0] > 0) - x[:, 3]))).astype(float)
    model = fit(x, y)
    rules = quality.extract_rules(x, y)
    z = quality.holds(rules, x)
    spread = z.std(axis=0)
    rules, z, spread = [r for r, s in zip(rules, spread) if s > 1e-6], z[:, spread > 1e-6], spread[spread > 1e-6]
    weight = dict(zip(model.rules, model.weights))
    w = np.array([weight.get(r, 0.0) for r in rules]) * spread
    error = model.score(x) - y
    slope = ((z - z.mean(0)) / spread).T @ error / len(y)
    assert abs(error.mean()) < 2e-3 and 0 < (w != 0).sum() < len(rules)
    assert np.abs(slope).max() < quality.LASSO + 2e-3
    assert np.abs(slope[w != 0] + quality.LASSO * np.sign(w[w != 0])).max() < 2e-3


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, *_ in rows()[:60]], "doc_id long, text string, _id long, _label long")
    labels = spark.createDataFrame([(i, q, 3) for i, _, _, q in rows()[:60]], "doc_id long, quality int, _id long")
    assert score(docs, learn(docs, labels)).count() == 60
