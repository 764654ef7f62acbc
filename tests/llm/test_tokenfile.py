import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from bytelode.llm import rans, tokenfile
from bytelode.llm.tokenfile import Encoder, encode_and_read, read_tokens, write_tokens

SCHEMA = "doc_id long, text string, start string, part long"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5000, 1), (1023, 3), (1024, 40), (700_000, 49_000), (1_200_000, 700)])
def test_segments_come_back(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 3 * kinds).astype(np.uint32) + 7
    assert np.array_equal(rans.Segment(rans.encode(ids)).ids(), ids)


def test_checkpoints_decode_alone_and_damage_is_seen():
    ids = np.random.default_rng(1).integers(0, 2**32 - 1, 600_000, dtype=np.uint32) % 5000
    data = rans.encode(ids)
    segment = rans.Segment(data)
    assert len(segment.blocks) == 2 and len(segment.blocks[0][2]) == 2
    step = segment.blocks[0][2][1][0]
    assert np.array_equal(segment.from_checkpoint(0, 1), ids[step * rans.LANES : rans.LANES * rans.BLOCK_STEPS])
    hurt = bytearray(data)
    hurt[-5] ^= 1
    with pytest.raises(rans.Damaged):
        rans.Segment(bytes(hurt)).ids()
    with pytest.raises(rans.Damaged):
        rans.Segment(data[:-100]).ids()
    assert len(data) < 600_000 * 2


def texts():
    rng = random.Random(2)
    parts = ["It's", "DON'T", "naïve", "é", "éa", "İstanbul", "ΣΑΣ", "12,5", "<|endoftext|>", "<|x", "a<|startoftext|>b", "a b", " ", "x\x1cy", "don’t", "日本語", "😀👍", "***", "(ok)", "The", "µ", "ﬁ", "ÀÉÎ", "Œuvre,", "ſŸŉ", "Åb", "a\u0301b", "x×y÷z"]
    return ["", None, " \n\t", "word " * 20_000] + [rng.choice([" ", "\n", "  ", "\r\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(200)]


def test_pieces_give_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 15)
    own, plain = Encoder(PATH), Encoder(PATH).tokenizer
    assert own.by_piece
    for t in texts():
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert own.encode([(t or "").encode()])[0].tolist() == want
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_piece
    assert other.encode([b" two  words "])[0].tolist() == other.tokenizer.encode(" two  words ", add_special_tokens=False).ids


def test_files_hold_every_text_in_id_order(spark):
    rows = [(i * 7 % 211, t, "x", 1) for i, t in enumerate(texts()[:60])] + [(None, "no id", "x", 1), (3, "same id", "x", 1), (3, "same id", "x", 1)]
    got = encode_and_read(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    plain = Encoder(PATH).tokenizer
    want = []
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_small_segments_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * i, "", 0) for i in range(50)], SCHEMA)
    write_tokens(df, f"{tmp_path}/a", PATH, 1, segment_tokens=100)
    assert spark.read.parquet(f"{tmp_path}/a").count() > 20
    one = {tuple(r) for r in read_tokens(spark, f"{tmp_path}/a").collect()}
    assert one == {tuple(r) for r in encode_and_read(df).collect()}
    assert encode_and_read(df.limit(0)).count() == 0


def test_bytes_that_are_no_text_count_as_replaced(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = spark.sql("SELECT 1L AS doc_id, cast(X'6f6e6520ff2074776f' AS STRING) AS text UNION ALL SELECT 2L, 'plain'")
    got = {r.doc_id: r.n_tokens for r in encode_and_read(rows).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert got == {1: size("one � two"), 2: size("plain")}
