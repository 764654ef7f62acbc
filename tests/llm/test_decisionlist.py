import os
import random
import re

import numpy as np
import pytest

from bytelode.llm import decisionlist
from bytelode.llm.common import held_out
from bytelode.llm.decisionlist import STATISTICS, DecisionList, Rule, base_counts, fit, judge, learn, repeat_words
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_words string, rule string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)}
    lines = text.split("\n")
    again = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k] for k, line in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)]


def test_counts_are_those_by_hand():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "é ü x", "x\r\nx\r\nx\n", "one two\none two\n\n \n one two", "### $$$ a|b <p>"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "日"]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    for t in texts:
        assert base_counts(None if t is None else t.encode()) == plain_counts(t), t
    assert repeat_words(["x"] * 100_000) == 100_000 and repeat_words([str(k) for k in range(100_000)]) == 0


def test_list_is_grown_for_what_tells_the_classes_apart():
    rng = np.random.default_rng(2)
    x = rng.random((600, len(STATISTICS)))
    y = ((x[:, 3] <= 0.7) | ((x[:, 5] > 0.4) & (x[:, 8] > 0.5))).astype(int)
    rules = fit(x, y)
    fresh = rng.random((2000, len(STATISTICS)))
    truth = (fresh[:, 3] <= 0.7) | ((fresh[:, 5] > 0.4) & (fresh[:, 8] > 0.5))
    assert (rules.decide(fresh) == truth).mean() > 0.95 and 1 <= len(rules.rules) <= decisionlist.MOST_RULES
    assert {i for r in rules.rules for i, _, _ in r.tests} <= {3, 5, 8} | set(range(len(STATISTICS))) and str(rules.rules[0]).endswith(("-> 0", "-> 1"))
    assert fit(x[:0], y[:0]).default == 1 and fit(x, np.zeros(600, int)) == DecisionList([], 0)
    assert all(sum(r.holds(x)) >= decisionlist.LEAST_COVER for r in rules.rules)


def test_the_expression_is_the_list(spark):
    rules = DecisionList([Rule(0, [(0, True, 6.0), (3, False, 0.5)]), Rule(1, [(3, True, 0.2)]), Rule(0, [(1, True, 0.0)])], 1)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "longer", "longest words", "#x", "one two three"]) for _ in range(rng.randint(20, 150))) for _ in range(80)]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(90, None, "", ""), (91, "", "", ""), (None, texts[0], "", ""), (0, texts[0], "", "")]
    got = judge(spark.createDataFrame(rows, DOCS).repartition(3), rules).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        counts = plain_counts(text[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        raw = text[r.doc_id].encode() if text[r.doc_id] else b""
        x = np.array([decisionlist.shares(counts, raw) + [decisionlist.quality.statistics(raw)[k] for k in decisionlist._TAKEN]])
        held = [k for k, rule in enumerate(rules.rules, 1) if rule.holds(x)[0]]
        assert r.kept == (not r.base_failed and rules.decide(x)[0] == 1)
        assert r.rule == (None if r.base_failed else held[0] if held else 0)


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 60, "", "")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = learn(docs, labels)
    assert rules == DecisionList([], 1) and judge(docs.limit(0), rules).count() == 0
    assert judge(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)), "", "")], DOCS), rules).first().kept


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    found = decisionlist.op13_decision_list_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    got = found.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert len(got) > 40 and sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)
