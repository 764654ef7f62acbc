from bytelode.llm import linededup
from bytelode.llm.linededup import drop_common_lines

SCHEMA = "doc_id long, text string, source string, common string, line long"


def plain(rows, least):
    sites = {}
    for _, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r") and s is not None:
                sites.setdefault(line.strip(" \t\n\x0b\x0c\r"), set()).add(s)
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if len(sites.get(x.strip(" \t\n\x0b\x0c\r"), ())) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    out = []
    for i in range(120):
        lines = [f"own {i}", "everywhere", f"pair {i // 2}", f"in {i % 9} sites" if i % 17 < 8 else "few  sites", "", " everywhere\t", f"group {i % 30}"]
        out.append((i, "\n".join(lines[i % 3 :]), f"site{i % 11}", "c", 1))
    return [*out, (None, "everywhere\nx", None, "c", 1), (500, None, "site1", "c", 1), (501, "", "site1", "c", 1), (501, "", "site1", "c", 1), (3, "everywhere\nz", "site2", "c", 1), (502, "everywhere\n" * 5000, "site3", "c", 1)]


def test_removes_what_many_sites_carry(spark, monkeypatch):
    for least in (2, 4, 5, 11, 12):
        got = drop_common_lines(spark.createDataFrame(rows(), SCHEMA).repartition(4), min_sites=least)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows(), least)
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    got = drop_common_lines(spark.createDataFrame(rows(), SCHEMA), min_sites=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows(), 4)


def test_many_sites_and_empty_table(spark):
    data = [(i, f"wide\nhalf {i % 2}\nnear {i % 3}", f"s{i}", "", 0) for i in range(3000)]
    got = drop_common_lines(spark.createDataFrame(data, SCHEMA), min_sites=1001)
    assert sorted(map(tuple, got.collect()), key=str) == plain(data, 1001)
    assert drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0
