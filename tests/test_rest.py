import math

import pytest

from bytelode.operators import cache, querylog
from bytelode.sources.corpus import compress_text, from_compressed
from bytelode.streaming.incremental import IncrementalCorpus


def test_query_log(spark):
    log = spark.createDataFrame([("seldom", 640.0)] + [("often", 35.0)] * 37 + [("at times", 80.0)] * 4, "pattern string, latency_us double").repartition(3)
    assert querylog.total(log).first().total == 42
    assert round(querylog.unique(log).first().unique_patterns) == 3 == querylog.unique(log, lg_k=None).first().unique_patterns
    got = {r.q: r.value for r in querylog.quantiles(log, [0.0, 0.5, 0.99, 1.0]).collect()}
    assert abs(got[0.5] - 35) <= 0.35 and abs(got[1.0] - 640) <= 6.4
    assert {r.pattern: r.n for r in querylog.frequency(log).collect()} == {"often": 37, "at times": 4, "seldom": 1}
    asked = spark.createDataFrame([("often",), ("never",)], "pattern string")
    got = {r.pattern: r.n for r in querylog.estimated_frequency(querylog.count_min(log), asked).collect()}
    assert got == {"often": 37, "never": 0}
    empty = log.limit(0)
    assert querylog.unique(empty).first().unique_patterns == 0 and querylog.quantiles(empty, [0.5]).count() == 0
    assert {r.n for r in querylog.estimated_frequency(querylog.count_min(empty), asked).collect()} == {0}


def test_quantiles_have_relative_error(spark):
    values = [math.exp(i / 40) - 1 for i in range(1000)]
    log = spark.createDataFrame([(v,) for v in values], "latency_us double")
    for r in querylog.quantiles(log, [0.01, 0.25, 0.5, 0.9, 0.99]).collect():
        exact = values[math.floor(r.q * (len(values) - 1))]
        assert abs(r.value - exact) <= 0.0101 * exact
    assert querylog.exact_quantiles(log, [0.5]).first().p50 == values[499]


def test_metrics_store(spark, tmp_path):
    store = querylog.MetricsStore(spark, f"{tmp_path}/m")
    log = spark.createDataFrame([(1000 * i, i % 5, 50.0 + i) for i in range(20)], "ts_ms long, result_count int, latency_us double")
    store.record(log.where("ts_ms < 10000"))
    store.record(log.where("ts_ms >= 10000"))
    assert [tuple(r) for r in store.latency(1000, 3000).collect()] == [(1000, 51.0), (2000, 52.0), (3000, 53.0)]
    assert [r.value for r in store.results(4000, 6000).collect()] == [4, 0, 1] and store.counts(0, 99999).count() == 20
    with pytest.raises(ValueError):
        store.scan("other", 0, 1)


def test_cache(spark):
    puts = spark.createDataFrame([(1, "a", [1]), (2, "b", [10, 42, 99]), (3, "a", [4, 5, 6]), (4, "", [])], "seq long, pattern string, positions array<long>")
    kept = cache.entries(puts)
    assert kept.count() == 3
    got = {r.pattern: (r.positions, r["count"]) for r in cache.get(kept, spark.createDataFrame([("a",), ("b",), ("",), ("c",)], "pattern string")).collect()}
    assert got == {"a": ([4, 5, 6], 3), "b": ([10, 42, 99], 3), "": ([], 0), "c": (None, None)}
    r = cache.hit_rate(puts).first()
    assert (r.lookups, r.entries, r.hit_rate) == (4, 3, 0.25)
    assert cache.hit_rate(puts.limit(0)).first().hit_rate == 0


def test_codec(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    packed = compress_text(docs).drop("text")
    assert {r.doc_id: r.text for r in from_compressed(packed).collect()} == {1: bytearray(b"hello world"), 2: None, 3: bytearray(b"")}
    bad = spark.createDataFrame([(1, bytearray(b"junk"))], "doc_id long, data binary")
    r = from_compressed(bad, strict=False).first()
    assert r.text is None and r.error
    with pytest.raises(Exception):
        from_compressed(bad).collect()


def chunks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq long, chunk string")


def counts(corpus, pattern):
    return {r.doc_id: r.n_matches for r in corpus.count([pattern]).collect()}


def test_incremental(spark, tmp_path):
    c = IncrementalCorpus(spark, f"{tmp_path}/c", 0)
    assert c.sample_step == 1 and not c.is_built() and c.buffer_len() == 0 and counts(c, "") == {} and c.locate_all(["a"]).count() == 0
    c.append(chunks(spark, [(1, 0, "hello wo"), (2, 0, "aaa")]))
    assert c.buffer_len() == 11 and not c.is_built() and counts(c, "hello") == {}
    assert c.rebuild() == 1 and c.is_built() and counts(c, "world") == {} and counts(c, "a") == {2: 3}
    c.append(chunks(spark, [(1, 1, "rld"), (2, 1, "aa")]))
    assert counts(c, "a") == {2: 3} and c.buffer_len() == 16
    assert c.rebuild() == 2 and counts(c, "world") == {1: 1} and counts(c, "a") == {2: 5}
    assert {r.doc_id: r.positions for r in c.locate_all(["l"]).collect()} == {1: [2, 3, 9]}
    assert {r.doc_id: (r.sp, r.ep) for r in c.index(f"{tmp_path}/i").search_range(["a"], absent=True).collect()} == {1: (0, 0), 2: (1, 6)}
    c.clear()
    assert not c.is_built() and c.buffer_len() == 0 and counts(c, "a") == {}


def test_stream_appends_once(spark, tmp_path):
    chunks(spark, [(1, 0, "abc"), (1, 1, "abc")]).write.parquet(f"{tmp_path}/in")
    c = IncrementalCorpus(spark, f"{tmp_path}/c")
    read = lambda: spark.readStream.schema("doc_id long, seq long, chunk string").parquet(f"{tmp_path}/in")
    c.append_stream(read(), f"{tmp_path}/k").awaitTermination()
    chunks(spark, [(1, 2, "ab")]).write.mode("append").parquet(f"{tmp_path}/in")
    c.append_stream(read(), f"{tmp_path}/k").awaitTermination()
    c.append_stream(read(), f"{tmp_path}/k").awaitTermination()
    c.rebuild()
    assert {r.doc_id: r.positions for r in c.locate_all(["ca"]).collect()} == {1: [2, 5]} and c.buffer_len() == 8


def test_exact_quantiles_hold_few_values_at_once(spark, monkeypatch):
    monkeypatch.setattr(querylog, "SELECT", 10)
    values = [float((i * 7919) % 5003) for i in range(5003)] + [17.0] * 3000
    log = spark.createDataFrame([(v,) for v in values] + [(None,)], "latency_us double").repartition(3)
    at = [0.0, 0.25, 0.375, 0.5, 0.99, 1.0]
    want = [sorted(values)[max(math.ceil(q * len(values)), 1) - 1] for q in at]
    got = querylog.exact_quantiles(log, at)
    assert list(got.first()) == want and got.columns == ["p0", "p25", "p37.5", "p50", "p99", "p100"]
    assert "percentile" not in got._jdf.queryExecution().toString()
    assert list(querylog.exact_quantiles(log.limit(0), [0.5]).first()) == [None]


def test_streams_do_not_overwrite_each_other(spark, tmp_path):
    schema = "doc_id long, seq long, chunk string"
    c = IncrementalCorpus(spark, f"{tmp_path}/c")

    def append(name, checkpoint):
        c.append_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"), f"{tmp_path}/{checkpoint}").awaitTermination()

    for k, name in enumerate(("one", "two")):
        chunks(spark, [(1, k, "abc")]).write.parquet(f"{tmp_path}/{name}")
        append(name, f"k{k}")
    assert c.buffer_len() == 6
    append("one", "k0")
    assert c.buffer_len() == 6  # nothing new
    chunks(spark, [(2, 0, "de")]).write.parquet(f"{tmp_path}/three")
    append("three", "new")  # as after a lost checkpoint: batch 0 again, but another stream
    assert c.buffer_len() == 8
    c.rebuild()
    assert counts(c, "abc") == {1: 2} and counts(c, "de") == {2: 1}


def test_texts_of_many_chunks(spark, tmp_path):
    c = IncrementalCorpus(spark, f"{tmp_path}/c")
    rows = [(1, i, bytearray(bytes([i % 256, 0xFF]))) for i in range(4000)] + [(2, 0, None), (3, 1, bytearray(b"b")), (3, None, bytearray(b"a")), (3, 1, bytearray(b"a"))]
    c.append(spark.createDataFrame(rows, "doc_id long, seq long, chunk binary").repartition(4))
    got = {r.doc_id: bytes(r.text) for r in c.texts().collect()}
    assert got == {1: b"".join(bytes(r[2]) for r in rows[:4000]), 2: b"", 3: b"aab"}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from bytelode import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://head:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(Elsewhere)
