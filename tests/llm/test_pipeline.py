import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from bytelode.llm.language import has_letter, learn_gate
from bytelode.llm.mixing import mix
from tests.llm.test_nearcopies import exact_kept

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "this very passage of the benchmark has words that no other text has in just such an order"


def documents():
    rng = random.Random(8)
    words = {"xx": [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)], "yy": [f"łóż{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]}
    out = []
    for i in range(150):
        lang = ("xx", "yy")[i % 3 == 0]
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 120)))
        if i % 10 == 1:
            text += " " + ITEM + " and more"
        out.append((i, text, lang, f"s{i % 4}"))
    out += [(200 + i, out[i][1].upper(), "xx", "s9") for i in range(0, 40, 2)]
    out += [(300, "12 34", "xx", "s1"), (301, None, None, "s1"), (302, "", "yy", None), (303, "x " * 20_000, "xx", None)]
    return [(*r, len(r[1] or "")) for r in out]


def test_stages_take_effect_and_run_is_what_they_give(spark, tmp_path):
    data = documents()
    spark.createDataFrame(data, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in seen]

    texts = {i: t for i, t, *_ in data}
    gate = learn_gate(docs)
    assert ids[1] == sorted(i for i, t in texts.items() if gate.stays([None if t is None else t.encode()]) == [True])
    assert ids[1] == sorted(i for i, t in texts.items() if t and has_letter(t.encode()))

    left = sorted(exact_kept({i: texts[i] for i in ids[1]}))
    assert ids[2] == left and len(left) < len(ids[1])
    assert ids[3] == [i for i in left if ITEM not in texts[i].lower()] and len(ids[3]) < len(left)

    copies = {r.doc_id: r.copies for r in mix(seen[3]).collect()}
    assert ids[4] == sorted(i for i, n in copies.items() for _ in range(n)) and max(copies.values()) > 1

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = [tuple(r) for r in seen[5].orderBy("start").collect()]
    for i, at, n, crc in got:
        want = tokenizer.encode(texts[i], add_special_tokens=False).ids + [1]
        assert (at, n, crc) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += n
    assert [r[0] for r in got] == ids[4]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(got)


def write(spark, folder, rows, **extra):
    schema = DOCS + "".join(f", {name} long" for name in extra)
    spark.createDataFrame([(*r, *extra.values()) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_without_labels_with_repeated_ids_and_clashing_names(spark, tmp_path):
    words = [" ".join(f"{a}{chr(97 + k)}{chr(97 + j % 26)}" for j in range(40)) for k, a in enumerate("qwertyuiop")]
    data = [(1, words[0], None, "s", 1), (1, words[1], None, "s", 1), (1, words[1], None, "s", 1), (None, words[2], None, None, None), (2, f"{words[3]} {ITEM}", None, "s", 1), (3, None, None, "s", 1), (3, "", None, None, 1)]
    names = dict.fromkeys("row doc order text_hash row_hash own_hash key found _id _hash _text _of _copy id".split(), 5)
    write(spark, tmp_path, data, **names)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert {(r.doc_id, r.n_tokens) for r in got} <= {(1, size(words[0])), (1, size(words[1])), (None, size(words[2]))} and len(got) > 0


def test_run_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
