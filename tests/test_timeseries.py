import random

import pytest

from bytelode.operators.timeseries import SeriesStore

SCHEMA = "series string, ts_ms long, value float"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def drawn(rng, n):
    """One series has most points; times repeat, are negative, and some values are null."""
    return [(rng.choice(["hot"] * 6 + ["a/b=c", "", "z"]), rng.randrange(-50, 250), rng.choice([None, 0.5, 1.0, 2.0])) for _ in range(n)]


def test_writes_compactions_and_scans_agree_with_a_list(spark, tmp_path):
    rng, store, held = random.Random(5), SeriesStore(spark, f"{tmp_path}/s", span_ms=40, buckets=4), []
    series = ["hot", "a/b=c", "", "z", "absent"]
    assert store.versions() == [] and rows(store.points(series, -99, 999)) == [] and store.vacuum() == []
    for step in range(4):
        more = drawn(rng, 60)
        held += more
        store.record(spark.createDataFrame(more, SCHEMA))
        if step in (1, 2):
            store.compact()
        for start, end in ((-99, 999), (rng.randrange(-50, 100), rng.randrange(100, 250))):
            assert rows(store.points(series, start, end)) == sorted((p for p in held if start <= p[1] <= end), key=str)
    order = lambda p: (p[0], p[1] is not None, p[1] or 0)
    assert [tuple(r) for r in store.scan("hot", -7, 80).collect()] == sorted(((t, v) for s, t, v in held if s == "hot" and -7 <= t <= 80), key=order)


def test_older_versions_failures_and_vacuum(spark, tmp_path, monkeypatch):
    store, point = SeriesStore(spark, f"{tmp_path}/s", span_ms=10), lambda t: spark.createDataFrame([("a", t, 1.0)], SCHEMA)
    for t in (1, 2, 2, 15):
        store.record(point(t))
    first = store.compact()
    store.record(point(3))
    # The parts are written, the manifest is not: nothing has changed.
    with monkeypatch.context() as broken:
        broken.setattr(store, "_seen", lambda versions: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.compact()
    assert store.versions() == [first] and [r.ts_ms for r in store.scan("a", 0, 99).collect()] == [1, 2, 2, 3, 15]
    second = store.compact()
    assert [r.ts_ms for r in store.scan("a", 0, 99, first).collect()] == [1, 2, 2, 15]
    assert store.vacuum() and store.versions() == [second]
    assert [r.ts_ms for r in store.scan("a", 0, 99).collect()] == [1, 2, 2, 3, 15]
    # Nothing new: the same parts, none is written again.
    before = sorted(store.points(["a"], 0, 99).inputFiles())
    store.compact()
    assert sorted(store.points(["a"], 0, 99).inputFiles()) == before
    store.vacuum()
    assert [r.ts_ms for r in store.scan("a", 0, 99).collect()] == [1, 2, 2, 3, 15]


def test_a_scan_opens_the_files_of_its_time(spark, tmp_path):
    store = SeriesStore(spark, f"{tmp_path}/s", span_ms=100)
    points = spark.range(10_000).selectExpr("'a' as series", "id as ts_ms", "float(id % 7) as value")
    for k in range(3):
        store.record(points.where(f"ts_ms % 3 = {k}").repartition(2))
    scattered = len(store.points(["a"], 0, 9999).inputFiles())
    store.compact()
    every, few = (len(store.points(["a"], *ends).inputFiles()) for ends in ((0, 9999), (4200, 4299)))
    assert scattered >= 300 and every == 100 and few == 1 and store.points(["a"], 4200, 4299).count() == 100


def test_no_points_and_points_without_a_time(spark, tmp_path):
    store = SeriesStore(spark, f"{tmp_path}/s")
    store.record(spark.createDataFrame([], SCHEMA))
    assert store.compact() == 1 and rows(store.points(["a"], 0, 9)) == []
    # Extra columns are not read; a series without a name is no series one can ask for.
    store.record(spark.createDataFrame([("a", None, 1.0, 1), (None, 1, 2.0, 2), ("a", 1, None, 3)], "series string, ts_ms long, value float, bucket int"))
    assert rows(store.points(["a"], 0, 9)) == [("a", 1, None)] and rows(store.points([], 0, 9)) == []
    store.compact()
    assert rows(store.points(["a"], 0, 9)) == [("a", 1, None)]
