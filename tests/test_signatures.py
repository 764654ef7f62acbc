import random

from bytelode.operators import search
from bytelode.operators.signatures import gram_bits, sign_texts

DOCS = "doc_id long, text binary"


def test_rows_are_those_of_a_scan_and_few_blocks_are_read(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(500, b"the Rare words"), (501, b""), (502, None), (503, b"\xff\xfe\xfd"), (504, b"rare wordy")]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    signed = sign_texts(df, f"{tmp_path}/signed", texts=20)
    rows = lambda found: sorted(map(tuple, found.select("doc_id", *found.columns[1:]).collect()))
    for patterns in (["Rare words", "rare word", "abcab"], ["zzz"], ["", "ab"], [b"\xff\xfe\xfd", b"\0"], []):
        for ci in (False, True):
            assert rows(signed.contains(patterns, ci)) == rows(search.contains(df, patterns, ci))
            assert rows(signed.count(patterns, ci)) == rows(search.count(df, patterns, ci))
    assert rows(signed.contains({"a": "Rare", "b": "abc"})) == rows(search.contains(df, {"a": "Rare", "b": "abc"}))
    assert signed.read_share(["rare word"]) <= 0.1 and signed.read_share(["zzz"]) == 0 and signed.read_share(["ab"]) == 1


def test_no_text_lacks_a_bit_of_what_it_holds():
    rng = random.Random(5)
    text = bytes(rng.randrange(256) for _ in range(3000))
    bits = set(gram_bits(text).tolist())
    assert all(set(gram_bits(text[k : k + 9].upper()).tolist()) <= bits for k in range(2900)) and not len(gram_bits(b"ab"))


def test_an_empty_table(spark, tmp_path):
    signed = sign_texts(spark.createDataFrame([], DOCS), f"{tmp_path}/none")
    assert signed.contains(["abc", ""]).count() == 0 and signed.read_share(["abc"]) == 0


def test_files_do_not_grow_with_blocks(spark, tmp_path):
    """Each block was a file of its own, and a task's."""
    df = spark.createDataFrame([(i, b"text %d" % i) for i in range(600)], DOCS).repartition(3)
    signed = sign_texts(df, f"{tmp_path}/signed", texts=10)
    sizes = sorted(r.n for r in signed.docs().groupBy("block").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect())
    assert 60 <= len(sizes) <= 64 and sizes[-1] == 10 and sum(sizes) == 600
    assert len(list((tmp_path / "signed" / "docs").glob("*.parquet"))) <= 4
