import argparse
import ast
import base64
import inspect
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelode.llm import language
from bytelode.llm.common import held_out
from bytelode.llm.language import drop_undetermined, has_letter, identify, learn, windows

SCHEMA = "doc_id long, text string, lang string, lang_pred string, found string"
WORDS = {"xx": ["thing", "with", "their", "other", "should"], "yy": ["żółć", "gęś", "jaźń", "łódź", "się"]}


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 300))), lang, "", "") for i in range(160) for lang in (("xx", "yy")[i % 4 == 0],)]
    return [*out, (500, None, "xx", "", ""), (501, "", "yy", "", ""), (502, "12 !? 3", "xx", "", ""), (None, "thing with other", "yy", "", ""), (503, "thing " * 30_000, None, "", ""), (503, "thing " * 30_000, None, "", "")]


def test_windows_cover_the_whole_text():
    text = bytes(range(1, 256)) * 5
    w = windows(text)
    assert b"".join(x[:256].tobytes() for x in w).rstrip(b"\0") == bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    assert windows(b"").shape == (1, 259)


def test_letters():
    assert [has_letter(x.encode()) for x in ("", "1 2", "é", "!" * 100 + "a", "日", "²%")] == [False, False, True, True, True, False]


def test_predicts_held_out_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    net = learn(df)
    got = identify(df, net).collect()
    assert len(got) == len(rows())
    truth = {r[0]: r[2] for r in rows() if r[0] is not None and r[0] < 500}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (500, 501, 502))
    assert by_id[503].lang_pred == by_id[None].lang_pred == "xx" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    kept = drop_undetermined(spark, df, "")
    assert kept.columns == df.columns and kept.count() == len(rows()) - 3


def test_without_labels_and_rows(spark):
    bare = spark.createDataFrame([(1, "some text", None, "", "")], SCHEMA)
    assert learn(bare) is None
    assert identify(bare, None).first().lang_pred == "und"
    assert identify(bare.limit(0), learn(bare.limit(0))).count() == 0


def test_stage_keeps_texts_where_nothing_can_be_learned(spark):
    bare = spark.createDataFrame([(1, "some text", None, "", ""), (2, "łódź", None, "", ""), (3, "12 !", None, "", ""), (4, None, None, "", "")], SCHEMA)
    kept = drop_undetermined(spark, bare, "")
    assert kept.columns == bare.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_network_is_the_convolution_by_hand():
    rng = np.random.default_rng(4)
    net = language.train(rng.integers(0, 256, (40, 259)).astype(np.uint8), rng.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    for text in (b"", b"Short", bytes(rng.integers(1, 256, 700).astype(np.uint8)), b"ab" * 300):
        held, totals = [], np.zeros(3)
        for at in range(0, max(1, len(text)), 256):
            lower = [b + 32 if 65 <= b <= 90 else b for b in text]
            seen = (lower[at : at + 259] + [0] * 259)[:259]
            best = [-math.inf] * 48
            for place in range(256):
                for f in range(48):
                    width = (2, 3, 4)[f // 16]
                    value = sum(float(net.embed[seen[place + k], e]) * float(net.filters[k * 8 + e, f]) for k in range(width) for e in range(8))
                    best[f] = max(best[f], value)
            hidden = [max(0.0, b + float(net.bias[f])) for f, b in enumerate(best)]
            logits = [sum(h * float(net.out[f, c]) for f, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(3)]
            odds = [math.exp(x - max(logits)) for x in logits]
            n = len(text[at : at + 256])
            held.append(n)
            totals += n * np.array(odds) / sum(odds)
        if not text:
            continue
        want = totals / sum(held)
        if not language.has_letter(text):
            continue
        (lang, score), = language.predict(net, [text])
        assert lang == net.langs[int(want.argmax())] and abs(score - want.max()) < 1e-4


def test_training_follows_the_gradient():
    """The loss falls along the step taken, and a narrow filter's unused rows stay zero."""
    rng = np.random.default_rng(5)
    wins = rng.integers(97, 110, (60, 259)).astype(np.uint8)
    labels = (wins[:, 10] % 2).astype(int)
    wins[labels == 1, 20:23] = np.frombuffer(b"xyz", np.uint8)
    loss = lambda net: -np.log(net.probabilities(wins)[np.arange(60), labels]).mean()
    short, long = (language.train(wins, labels, ["a", "b"], epochs=n) for n in (1, 40))
    assert loss(long) < 0.1 < loss(short)
    assert not long.filters[16:, :16].any() and not long.filters[24:, 16:32].any() and not long.embed[0].any()


def test_windows_are_drawn_from_whole_texts(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "train", lambda wins, labels, langs: taken.append((wins, labels, langs)))
    words = " ".join(f"{i:06d}word" for i in range(20_000))
    df = spark.createDataFrame([(1, words, "xx"), (3, "short text", "yy"), (None, words, "xx")], "doc_id long, text string, lang string")
    learn(df, per_lang=100)
    wins, labels, langs = taken[0]
    assert langs == ["xx", "yy"] and 60 < (labels == 0).sum() < 140 and (labels == 1).sum() == 1
    places = sorted(int(re.search(rb"(\d{6})word", w.tobytes())[1]) for w in wins[labels == 0])
    assert places[0] < 1500 and places[-1] > 18_500


def junk(rng, clean):
    """Texts in no language, of five kinds, by other means than those the gate is trained with."""
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    program = inspect.getsource(argparse) + inspect.getsource(ast)
    return {
        "letters": [run("abcdefghijklmnopqrstuvwxyz ", 400) for _ in range(100)],
        "encoded": [base64.b64encode(rng.randbytes(300)).decode() for _ in range(50)] + [base64.b64encode(t[:300].encode()).decode() for t in clean[:50]],
        "cyrillic": [run("абвгдежзийклмнопрстуфхцчшщъыьэюя ", 300) for _ in range(100)],
        "cjk": ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(120)) for _ in range(100)],
        "program": [program[k : k + 1500] for k in range(2000, 62_000, 1500)],
    }


@pytest.mark.parametrize("langs", [["de", "en", "es", "fr"], ["de", "en"]])
def test_gate_keeps_languages_and_rejects_the_rest(spark, langs):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("lang").isin(langs))
    clean = [r.text for r in docs.where(held_out(F.col("doc_id")) & F.col("text").isNotNull()).collect() if has_letter(r.text.encode())]
    gate = language.learn_gate(docs)
    kept = lambda texts: sum(gate.stays([t.encode() for t in texts])) / len(texts)
    assert kept(clean) >= 0.995 and kept([" ".join(t.split()[:8]) for t in clean]) >= 0.97
    assert {kind: kept(texts) for kind, texts in junk(random.Random(4), clean).items() if kept(texts) > 0.1} == {}


def test_stage_judges_by_the_gate(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(["thing", "żółć", "both of them", None, "12"])], "doc_id long, text string, found long, row long")
    net = language.ByteNet(["", "a"], *[None] * 5)
    monkeypatch.setattr(language, "learn_gate", lambda docs: language.Gate(net, 0.7))
    monkeypatch.setattr(language.Gate, "stays", lambda self, texts: [t is not None and t.startswith(b"both") for t in texts])
    kept = drop_undetermined(spark, df, "")
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2]
