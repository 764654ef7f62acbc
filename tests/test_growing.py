import random
import re

import pytest

from bytelode.streaming.incremental import IncrementalCorpus

CHUNKS = "doc_id long, seq long, chunk binary"


def places(text, pattern):
    return [k for k in range(len(text) - len(pattern) + 1) if text[k : k + len(pattern)] == pattern] if b"\0" not in pattern else []


def chunked(rng, text):
    out = []
    while text:
        n = rng.randint(0, 9)
        out.append(text[:n])
        text = text[n:]
    return out or [b""]


@pytest.mark.parametrize("ci", [False, True])
def test_matches_come_once_as_chunks_come(spark, tmp_path, ci):
    """After each run, from the same checkpoint, the matches are those of the texts so far."""
    rng = random.Random(3)
    patterns = [b"", b"a", b"abA", b"aa", b"bababab", b"\0", b"ab"]
    parts = {i: chunked(rng, bytes(rng.choice(b"abAB") for _ in range(rng.randint(0, 60)))) for i in range(10)}
    corpus = IncrementalCorpus(spark, f"{tmp_path}/corpus")
    sent = dict.fromkeys(parts, 0)
    for _ in range(3):
        rows = []
        for i, own in parts.items():
            upto = rng.randint(sent[i], len(own))
            rows += [(i, k, own[k]) for k in range(sent[i], upto)]
            sent[i] = upto
        rng.shuffle(rows)
        spark.createDataFrame([*rows, (None, 1, b"ab")], CHUNKS).repartition(2).write.mode("append").parquet(f"{tmp_path}/arrived")
        stream = spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/arrived")
        corpus.search_stream(stream, patterns, f"{tmp_path}/checkpoint", ci).awaitTermination()
        fold = (lambda x: x.lower()) if ci else (lambda x: x)
        texts = {i: fold(b"".join(own[: sent[i]])) for i, own in parts.items() if sent[i]}
        want = sorted((i, k, at) for i, t in texts.items() for k, p in enumerate(patterns) for at in places(t, fold(p)))
        assert sorted(map(tuple, corpus.found().collect())) == want


def test_a_chunk_out_of_order_stops_the_stream(spark, tmp_path):
    corpus = IncrementalCorpus(spark, f"{tmp_path}/corpus")
    for k, seq in enumerate((5, 4)):
        spark.createDataFrame([(1, seq, b"ab")], CHUNKS).write.mode("append").parquet(f"{tmp_path}/arrived")
        query = corpus.search_stream(spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/arrived"), ["a"], f"{tmp_path}/checkpoint")
        if k:
            with pytest.raises(Exception, match="comes after"):
                query.awaitTermination()
        else:
            query.awaitTermination()


def sizes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_rebuild_writes_what_has_changed(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, 0, bytes(rng.choice(b"abcdefgh") for _ in range(200))) for i in range(600)]
    corpus = IncrementalCorpus(spark, str(tmp_path))
    texts = lambda version=None: {r.doc_id: bytes(r.text) for r in corpus.snapshot(version).collect()}
    assert texts() == {} and not corpus.is_built()
    corpus.append(spark.createDataFrame(rows, CHUNKS))
    assert corpus.rebuild() == 1
    before = {i: t for i, _, t in rows}
    assert texts() == before
    changed = [7, 100, 311, 42, 599, 600]  # one of a hundred, and a new text
    corpus.append(spark.createDataFrame([(i, 1, b"more") for i in changed], CHUNKS))
    assert texts() == before and corpus.buffer_len() == 600 * 200 + 24
    assert corpus.rebuild() == 2
    after = before | {i: before.get(i, b"") + b"more" for i in changed}
    assert texts() == after and texts(1) == before
    first, second = (sizes(tmp_path / "texts" / f"version={v}") for v in (1, 2))
    assert second < 0.05 * first
    corpus.append(spark.createDataFrame([(7, -1, b"in front ")], CHUNKS))
    assert corpus.rebuild() == 3 and texts()[7] == b"in front " + after[7]
    assert corpus.rebuild() == 4 and texts()[7] == b"in front " + after[7] and not (tmp_path / "texts" / "version=4").exists()


def test_a_rebuild_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    corpus = IncrementalCorpus(spark, str(tmp_path))
    corpus.append(spark.createDataFrame([(1, 0, b"one"), (None, 0, b"no id")], CHUNKS))
    corpus.rebuild()
    corpus.append(spark.createDataFrame([(1, 1, b" two"), (2, 0, b"other")], CHUNKS))
    whole = IncrementalCorpus._joined
    with monkeypatch.context() as m:
        m.setattr(IncrementalCorpus, "_joined", lambda self, log: whole(self, log).selectExpr("doc_id", "assert_true(false) IS NULL AS x", "text", "bucket"))
        with pytest.raises(Exception):
            corpus.rebuild()
    texts = lambda: {r.doc_id: bytes(r.text) for r in corpus.snapshot().collect()}
    assert texts() == {1: b"one", None: b"no id"}
    assert corpus.rebuild() == 2 and texts() == {1: b"one two", 2: b"other", None: b"no id"}
    assert re.fullmatch("\\d+", str(corpus.buffer_len()))
