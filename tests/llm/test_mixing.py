import math
import os
import re
import struct

import pytest
import xxhash

from bytelode.llm import mixing
from bytelode.llm.common import row_hash
from bytelode.llm.mixing import mix, source_targets, take_copies

SCHEMA = "doc_id long, text string, source string, size long, target string"


def plain_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, rest, left = {}, set(order), sum(sizes.values())
    while rest:
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        rest -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 1, "é": 50, None: 3}, {"a": 0, "b": 0}, {"z": 0, "y": 9, "x": 500, "w": 20, "v": 1}])
def test_targets_are_the_reshared_ones(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def rows():
    out = [(i, " ".join(["w"] * (i * 7 % 23 + 1)), f"s{i % 7 if i % 3 else 0}", 1, "x") for i in range(600)]
    return [*out, (None, None, None, 1, "x"), (900, "", "s1", 1, "x"), (901, "\x0b one\ttwo ", None, 1, "x"), (901, "\x0b one\ttwo ", None, 1, "x"), (902, "long " * 3000, "s2", 1, "x")]


def test_each_source_comes_near_its_target_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df.repartition(5)).collect()
    assert len(got) == len(data)
    words = {}
    for _, t, s, *_ in data:
        words[s] = words.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(words)
    taken = {}
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, t in taken.items():
        sizes = sorted(r.size for r in got if r.source == s and r.size)
        # One document that is most of its source is taken or not.
        assert abs(t - want[s]) <= max(0.02 * want[s], sum(sizes[:3]), sizes[-1] if sizes[-1] > sum(sizes[:-1]) else 0)
    again = mix(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, mix(df, seed=8).collect()))


def test_fractions_round_without_bias(spark):
    df = spark.createDataFrame([(i, "a b" if i % 2 else "a b c", "s" if i < 60 else "t", 1, "") for i in range(90)], SCHEMA).cache()
    mean = sum(sum(r.copies for r in mix(df, seed=k).collect() if r.source == "s" and r.doc_id < 30) for k in range(12)) / 12 / 30
    rate = plain_targets({"s": 150, "t": 75})["s"] / 150
    assert abs(mean - rate) < 0.12


def test_stage_repeats_rows(spark):
    data = rows()[:40] + [(7, "other text", "s1", 1, "x"), (7, "other text", "s1", 1, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    copies = {}
    for r in mix(df).collect():
        copies[(r.doc_id, r.source, r.size)] = copies.get((r.doc_id, r.source, r.size), 0) + r.copies
    got = take_copies(spark, df, "")
    assert got.columns == df.columns and got.count() == sum(copies.values())
    assert mix(df.limit(0)).count() == 0


def test_stage_gives_back_rows_that_differ_elsewhere_and_clashing_names(spark):
    schema = "doc_id long, text string, source string, tag string, row_hash long, _id string, _text string, _of string, _hash string, _copy string, copies long"
    data = [(1, "a b c", "s", tag, 5, "i", "t", "o", "h", "c", None) for tag in ("x", "y", None)] * 2 + [(None, "a b c", None, "z", 5, "i", "t", "o", "h", "c", 9), (2, None, "s", "x", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, schema).repartition(3)
    mixed = {}
    for r in mix(df, tie=row_hash(df)).collect():
        mixed[r.row_hash] = mixed.get(r.row_hash, 0) + r.copies
    got = take_copies(spark, df, "")
    assert got.columns == df.columns
    want = {}
    for r in df.select("*", row_hash(df).alias("own")).distinct().collect():
        want[str(tuple(r)[:-1])] = mixed[r.own]
    found = {}
    for r in got.collect():
        found[str(tuple(r))] = found.get(str(tuple(r)), 0) + 1
    assert found == {k: n for k, n in want.items() if n} and len(found) > 2
    assert take_copies(spark, df.limit(0), "").count() == 0


def plain_mix(rows, most, seed):
    """The same rounding by hand: fractions meet in buckets, by (source, id, hash); then buckets meet."""
    words = {}
    for source, _, _, size in rows:
        words[source] = words.get(source, 0) + size
    targets = plain_targets(words, most)
    copies, live, late = {}, {}, {}
    hashed = lambda k, i, h: signed(xxhash.xxh64_intdigest(struct.pack("<q", h), signed_seed(seed + k, i)))
    waits = {}
    for source in words:
        bits = sorted(r[3].bit_length() for r in rows if r[0] == source and r[3])
        upto = {b: sum(x <= b for x in bits) for b in bits}
        waits[source] = next(((b, mixing.WAITING / n) for b, n in upto.items() if n >= min(mixing.WAITING, math.ceil(len(bits) / 4))), None)
    for source, i, h, size in rows:
        rate = targets[source] / words[source] if words[source] else 0.0
        whole = math.floor(rate + 1e-9)
        part = max(rate - whole, 0.0)
        copies[i] = whole
        if size > 0 and part > 1e-9:
            if size.bit_length() <= waits[source][0] and hashed(1, i, h) % 2**53 / 2**53 < waits[source][1]:
                late.setdefault((0, source), []).append([i, h, size, part])
            else:
                live.setdefault((hashed(0, i, h) % mixing.BUCKETS, source), []).append([i, h, size, part])
        elif size == 0 and hashed(0, i, h) % 2**53 / 2**53 < part:
            copies[i] += 1
    level, step = 0, mixing.BUCKETS
    draw = lambda *parts: xxhash.xxh64_intdigest(repr((level, parts)), seed) / 2**64
    while True:
        last, left = mixing.FAN_IN**level >= mixing.BUCKETS, {}
        for place, docs in late.items() if last else ():
            live.setdefault(place, []).extend(docs)
        for (bucket, source), docs in live.items():
            docs.sort(key=lambda d: (-d[2], *d))
            held = None
            while last and docs:  # the first against all others together
                (i, h, size, x), rest = docs[0], docs[1:]
                there = sum(d[2] * d[3] for d in rest)
                room = sum(d[2] * (1 - d[3]) for d in rest)
                to_doc, to_rest = min(size * (1 - x), there), min(size * x, room)
                up, down = there >= size * (1 - x), room >= size * x
                if to_doc + to_rest > 1e-9 and (up if up != down else draw(i, h) * (to_doc + to_rest) < to_rest):
                    x += to_doc / size
                    for d in rest:
                        d[3] *= 1 - to_doc / there
                elif to_doc + to_rest > 1e-9:
                    x -= to_rest / size
                    for d in rest:
                        d[3] = 1 - (1 - d[3]) * (1 - to_rest / room)
                elif 1e-9 < x < 1 - 1e-9:
                    x = draw(i, h) < x
                if 1e-9 < x < 1 - 1e-9:
                    x = xxhash.xxh64_intdigest(repr((level + 1, (i, h))), seed) / 2**64 < x
                copies[i] += round(x)
                docs = rest
            for doc in docs:
                if held is None:
                    held = doc
                    continue
                a, b = held, doc
                up_room = min(a[2] * (1 - a[3]), b[2] * b[3])
                down_room = min(a[2] * a[3], b[2] * (1 - b[3]))
                moved = up_room if draw(a[0], a[1], b[0], b[1]) * (up_room + down_room) < down_room else -down_room
                a[3] += moved / a[2]
                b[3] -= moved / b[2]
                held = None
                for d in (a, b):
                    if min(d[3], 1 - d[3]) < 1e-9:
                        copies[d[0]] += round(d[3])
                    else:
                        held = d
            if held is not None:
                left.setdefault((bucket // mixing.FAN_IN, source), []).append(held)
        if last:
            return copies
        live, level = left, level + 1


def test_given_sources_come_within_a_few_words_in_a_hundred(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    taken = {}
    for r in mixing.op8_pivotal_mix(spark, folder).collect():
        t = taken.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert len(taken) > 10 and all(abs(got - target) <= 0.02 * target for target, got in taken.values())


def test_repeated_rows_share_their_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_STEP", 7)
    data = [(1, "a b c d", "s", 1, "")] * 50 + [(i, "a b c", "t", 1, "") for i in range(100, 130)]
    got = mix(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    same = [r.copies for r in got if r.doc_id == 1]
    rate = plain_targets({"s": 200, "t": 90})["s"] / 200
    assert len(got) == 80 and len(same) == 50 and max(same) - min(same) <= 1 and abs(sum(same) - 50 * rate) < 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def signed_seed(seed, i):
    """Spark hashes columns in turn: each one's hash seeds the next."""
    return xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))


def test_one_small_mix_is_the_rounding_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    data = [(i, " ".join(["w"] * (i * 5 % 17)), f"s{i % 5}", 1, "x") for i in range(150)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df).collect()
    by_hand = plain_mix([(r.source, r.doc_id, r.text_hash, r.size) for r in got], mixing.MOST, 7)
    assert {r.doc_id: r.copies for r in got} == by_hand
