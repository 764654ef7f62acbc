import random
import re

import regex

from bytelode.llm import decontaminate
from bytelode.llm import decontaminate as d
from bytelode.llm.decontaminate import contaminated_pairs, drop_contaminated

DOCS = "doc_id long, text string, item_id long, words string"
ITEMS = "item_id long, text string, pos long"
ITEM = "On Monday morning Alice bought 12 apples and gave Robert 5 apples. How many of the 12 apples does Alice keep when the walk is 3 km long?"
COPY = "On Monday morning Carol bought 47 apples and gave Dennis 9 apples. How many of the 47 apples does Carol keep when the walk is 8 miles long?"
TORN = COPY.replace("of the 47", "of the 31")
OTHER = "This passage is about nothing else, and no document holds a word of it in such an order at all."


def pairs(spark, docs, items):
    got = contaminated_pairs(spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()
    return sorted(((r.doc_id, r.item_id) for r in got), key=str)


def test_finds_copies_with_other_names_numbers_and_units(spark):
    docs = [(1, f"Before it. {ITEM} After it."), (2, COPY), (3, TORN), (4, f"x%%% {OTHER.upper()}!! y"), (5, "apples and gave 5 apples how many"), (6, f"{TORN}\n{ITEM}"), (None, COPY), (7, None), (8, ""), (9, "12 5 3 7 9 11"), (10, "filler word " * 20_000 + ITEM), (10, "filler word " * 20_000 + ITEM)]
    assert pairs(spark, docs, [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "7 8 9"), (1, ITEM)]) == sorted([(1, 1), (2, 1), (4, 2), (6, 1), (None, 1), (10, 1)], key=str)


def test_shuffled_join_and_short_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs = [(1, ITEM), (2, "Two words."), (3, "not two words")]
    assert pairs(spark, docs, [(1, ITEM), (2, "two words"), (3, ITEM)]) == [(1, 1), (1, 3), (2, 2), (3, 2)]
    assert pairs(spark, docs[:2], [(None, ITEM), (None, None), (None, "two words")]) == [(1, None), (2, None)]


def test_empty_tables(spark):
    assert pairs(spark, [], [(1, ITEM)]) == [] and pairs(spark, [(1, ITEM)], []) == []


def test_stage_drops_only_what_holds_an_item(spark, tmp_path):
    spark.createDataFrame([(1, ITEM, 0)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, COPY, 0, ""), (1, "clean", 0, ""), (2, TORN, 0, ""), (None, None, 0, ""), (3, "", 0, "")], DOCS)
    kept = drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "clean"), (2, TORN), (None, None), (3, "")], key=str)


def stage_keeps(spark, folder, docs, items):
    spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return sorted(r.doc_id for r in drop_contaminated(spark, spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS), str(folder)).collect())


def test_stage_finds_names_that_open_sentences(spark, tmp_path):
    item = "Alice has 5 apples. Alice gives 2 apples to Robert. How many apples does Alice have?"
    copy = item.replace("Alice", "Carol").replace("Robert", "Dennis").replace("5", "31").replace("2", "17")
    torn = copy.replace("Carol gives", "Wendy gives")
    docs = [(1, item), (2, copy), (3, f"Before.\n{copy}\nAfter."), (4, torn), (6, f'He said: "{copy}"')]
    assert stage_keeps(spark, tmp_path, docs, [(1, item)]) == [4]


def test_finds_names_in_capitals(spark):
    assert pairs(spark, [(1, f"x {ITEM.upper()}"), (2, COPY.upper())], [(1, ITEM)]) == [(1, 1)]


def test_stage_finds_short_and_literal_poor_items(spark, tmp_path):
    sums = "12 + 35 * 7 = 257 and 3 km 4 km"
    docs = [(1, "so this is not two words either"), (2, f"before it {sums} after it"), (3, f"before it {sums.replace('35', '36')} after it"), (4, "two other words"), (5, "2 plus 2 makes a four"), (6, "")]
    assert stage_keeps(spark, tmp_path, docs, [(1, "Two words!"), (2, sums), (3, "2 plus 2"), (None, None), (4, "?")]) == [3, 4, 6]


PUNCTUATION = rf"[^\p{{L}}\p{{M}}\p{{N}}{d.NAME}-{d.UNIT}\x20\x09-\x0D]+"


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", regex.sub(PUNCTUATION, "", text.lower())) if w]


NAMED = (r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+", r"(?<![\p{L}\p{M}\p{N}])\p{Lu}\p{Ll}+")


def plain_template(text, name):
    text = regex.sub(name, d.NAME, text)
    text = regex.sub(r"\p{N}+(?:[.,]\p{N}+)*", d.NUMBER, text).lower()
    text = regex.sub(rf"{d.NUMBER}( ?)(?:{'|'.join(d.UNITS)})(?=[^\p{{L}}]|$)", rf"{d.NUMBER}\1{d.UNIT}", text)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", regex.sub(PUNCTUATION, "", text)) if w]


def plain_windows(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def slot(word):
    return any(c in word for c in (d.NAME, d.NUMBER, d.UNIT))


def torn_shifts(hits, form, asked, words):
    """Alignments along which a value of the item stands for more than one of the document."""
    out = set()
    for shift in {s for _, s in hits}:
        values = {}
        for at in (a for a, s in hits if s == shift):
            for x in range(at, min(at + 5, len(form))):
                if slot(form[x]) and x + shift < len(words):
                    values.setdefault(asked[x], set()).add(words[x + shift])
        if any(len(v) > 1 for v in values.values()):
            out.add(shift)
    return out


def places(asked, seen):
    """(window's place, shift) of the asked windows that are seen."""
    spots = {}
    for at, run in enumerate(plain_windows(seen)):
        spots.setdefault(run, []).append(at)
    return {(at, p - at) for at, run in asked.items() for p in spots.get(run, ())}


def plain_pairs(docs, items):
    """Items found in documents, by hand, in the best of the ways: by templates of either form on alignments
    without a torn slot, or by plain words."""
    out = {}
    for i, text in docs:
        words = plain_words(text)
        for k, item in items:
            asked, n, covered, sound, slots = plain_words(item), 0, set(), set(), False
            ways = []
            for number, name in enumerate(NAMED):
                form = plain_template(item, name)
                assert len(words) == len(plain_template(text, name)) and len(form) == len(asked)
                wanted = {at: run for at, run in enumerate(plain_windows(form)) if sum(not slot(w) for w in run) >= min(2, len(run))}
                n = len(wanted) if number == 0 else n
                hits = places(wanted, plain_template(text, name))
                slots |= any(slot(w) for at, _ in hits for w in wanted[at])
                torn = torn_shifts(hits, form, asked, words)
                covered |= {at for at, _ in hits}
                sound |= {at for at, s in hits if s not in torn}
            if n and len(covered) >= 0.8 * n:
                ways.append((len(sound if slots else covered), n))
            if len(asked) >= 5:
                wanted = dict(enumerate(plain_windows(asked)))
                ways.append((len({at for at, _ in places(wanted, words)}), len(wanted)))
            elif asked and any(words[at : at + len(asked)] == asked for at in range(len(words))):
                ways.append((1, 1))
            ways = [(m / n, n, m) for m, n in ways if m >= 0.8 * n]
            if ways:
                out[(i, k)] = max(ways)
    return {(i, k, m, n) for (i, k), (_, n, m) in out.items()}


NAMES, THINGS = ["Alice", "Robert", "Carol", "Dennis", "Émile", "Wendy"], ["apples", "pears", "coins", "stamps"]


def generated():
    rng = random.Random(12)

    def question(a, b, x, y, thing, unit):
        return f"On Monday {a} has {x} {thing} and gives {b} {y} {thing}, so {a} walks {x} {unit} and keeps the rest of the {x} {thing} while {b}, with {y} {thing}, walks {y} {unit} home again."

    items, docs = [], []
    for k in range(8):
        a, b = rng.sample(NAMES, 2)
        items.append((k, question(a, b, rng.randint(10, 99), rng.randint(2, 9), rng.choice(THINGS), rng.choice(["km", "miles"]))))
    for i in range(60):
        a, b = rng.sample(NAMES, 2)
        x, y, thing = rng.randint(10, 99), rng.randint(2, 9), rng.choice(THINGS)
        text = question(a, b, x, y, thing, rng.choice(["km", "m", "miles"]))
        kind = i % 6
        if kind == 1:  # a number, or a name, that does not stay what it was
            text = text[::-1].replace(str(x)[::-1], str(x + 1)[::-1], 1)[::-1]
        elif kind == 2:
            text = text.replace(f"so {a}", f"so {rng.choice([n for n in NAMES if n not in (a, b)])}")
        elif kind == 3:  # two alignments in one document, one of them torn
            text = text.replace(f"so {a}", "so Nobody") + " " + question(a, b, x, y, thing, "km")
        elif kind == 4:  # a part only
            text = " ".join(text.split()[: rng.randint(20, 36)])
        docs.append((i, f"Before it\n{text} and after it" if i % 2 else text))
    docs += [(100, f"now {items[0][1].upper()} and"), (101, "so these are not two words"), (102, "12 7 9"), (103, items[1][1])]
    return docs, items + [(20, "12 7 9"), (21, "two words")]


def test_slots_are_checked_as_by_hand_and_in_sql(spark, tmp_path, monkeypatch):
    import duckdb

    docs, items = generated()
    want = plain_pairs(docs, items)
    spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = lambda: {(r.doc_id, r.item_id, r.n_matched, r.n_windows) for r in d.op9_template_decontamination(spark, str(tmp_path)).collect()}
    assert found() == want
    torn = {i for i, _ in docs if i % 6 in (1, 2) and i < 100}
    assert {i for i, *_ in want} & {i for i, _ in docs if i % 6 in (0, 3, 5)} and not {i for i, *_ in want} & torn
    assert {(100, 0), (101, 21), (102, 20), (103, 1)} <= {(i, k) for i, k, *_ in want}
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    rows = con.sql(f"select doc_id, item_id, n_matched, n_windows from ({d.OP9_SQL})").fetchall()
    assert set(rows) == want and len(rows) == len(want)
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert found() == want
    monkeypatch.setattr(d, "BROADCAST_HASHES", 0)
    assert found() == want


def test_stage_with_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, ITEM, 0)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, COPY, 7, 8, 9), (2, "clean", 7, 8, 9)], "doc_id long, text string, _id long, _hash long, text_hash long")
    kept = drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 7, 8, 9)]
