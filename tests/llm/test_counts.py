import random

import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from bytelode.llm import counts
from bytelode.llm.counts import SPACE, Counter, token_counts, unigram_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_are_the_librarys_on_ties_and_unknowns():
    rng = random.Random(1)
    for trial in range(60):
        pieces = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 25))} | ({SPACE} if trial % 2 else {SPACE + "a"})
        vocabulary = [("<unk>", 0.0), *((p, -float(rng.randint(1, 4))) for p in sorted(pieces))]
        library, own = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=False)), Counter(vocabulary)
        for _ in range(120):
            word = SPACE + "".join(rng.choice("aabbcéxy") for _ in range(rng.randint(0, 14)))
            assert own.pieces(word) == len(library.encode(word, add_special_tokens=False).ids), (vocabulary, word)


def test_counts_are_the_librarys_on_the_public_vocabulary(spark, monkeypatch):
    vocabulary = unigram_vocabulary(PATH)
    assert len(vocabulary) > 31_000
    library = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=False))
    rng = random.Random(2)
    parts = ["The", "thntblere", "étoile", "日本", "😀", "<unk>", "▁x", "12,500", "don't", "a" * 300, "###", "Äpfel"]
    texts = ["", None, " \n", "word " * 20_000] + [rng.choice([" ", "\n", "\t "]).join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    monkeypatch.setattr(counts, "REMEMBERED", 5)
    df = spark.createDataFrame([(i // 2, t, "x", 7) for i, t in enumerate(texts)] + [(None, "The end", "x", 7)], "doc_id long, text string, n_words string, id long")
    got = sorted(map(tuple, token_counts(df.repartition(3)).collect()), key=str)
    want = []
    for i, t in [*((i // 2, t) for i, t in enumerate(texts)), (None, "The end")]:
        words = [w.decode() for w in (t or "").encode().split()]
        want.append((i, len(words), sum(len(library.encode(SPACE + w, add_special_tokens=False).ids) for w in words)))
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_a_long_word_takes_no_more_memory(spark):
    import tracemalloc

    vocabulary = unigram_vocabulary(PATH)
    own, library = Counter(vocabulary), Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=False))
    rng = random.Random(3)
    for word in ("".join(rng.choice("theandof日é0x") for _ in range(60_000)), "a" * 5_000):
        assert own.pieces(SPACE + word) == len(library.encode(SPACE + word, add_special_tokens=False).ids)
    word = "".join(rng.choice("abcdefgh") for _ in range(1_000)) * 1_000
    tracemalloc.start()
    assert own.pieces(word) > 100_000
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    assert token_counts(spark.createDataFrame([(1, word)], "doc_id long, text string")).first().n_words == 1


def test_bytes_that_are_no_text_count_as_replaced(spark):
    rows = spark.sql("SELECT 1L AS doc_id, cast(X'6f6e6520ff2074776f' AS STRING) AS text UNION ALL SELECT 2L, 'one � two'")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(rows).collect()}
    assert got[1] == got[2] and got[1][0] == 3
