"""Spelling variants: words one edit apart, found by an automaton over the halves of all words.

Of a word with one inserted, deleted or replaced character one half stays as it is, at its end of the word. So
each word is held by two automaton shards, those of its two halves (with its length), and is scanned by the
shards of the at most six halves that a near word can have. A shard's Aho-Corasick automaton reports the
segments in a scanned word; those at another offset than the half's, or of a word whose length differs by more than
one, are no candidates, and the others' remaining halves are held against each other.

Where many words share a half, the rest of the scanned word is edited in all ways instead, and looked up: a scan
costs the lesser of both. A half that more than BLOCK words share is dealt to several shards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.patterns import FOLD
from .common import Scratch, default_partitions, table
from .sharding import CRC32_STEPS

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A word's code points and occurrences at least, and how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run loses a code point where this divides its checksum.
DAMAGE = 199
#: Halves that a shard's automaton holds, about, and words of one half that one shard holds at most, about.
SHARD, BLOCK = 20_000, 50_000
#: Different words that a task counts before it sends them.
SEND = 200_000


def words_of(doc_id: str, text: bytes) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text, words of any length; a word may come twice."""
    for run, n in Counter(RUN.findall(text.translate(FOLD).decode("utf-8", "replace"))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def _count_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of("" if doc_id is None else doc_id, text.as_py()):
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) > SEND:
                    yield send()
                    held.clear()
        yield send()

    return run


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts with so many code points and occurrences.

    Words are runs of letters with A-Z lowered. One run in 199, by a checksum of id and run, first loses a code point. Null texts
    have no words; a null id counts as the empty text in the checksum. Bytes that are no UTF-8 end a run.
    Repeated rows count each. An empty table gives no rows.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = texts.mapInArrow(_count_batches(least_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes the one from the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


class _Rests:
    """What is left of the words of one length that share one half."""

    def __init__(self) -> None:
        self.n: dict[str, int] = {}
        self.letters: str | None = None

    def near(self, rest: str, longer: int) -> list[str]:
        """Those one edit from `rest` that have `longer` characters more: -1, 0 or 1."""
        if self.letters is None:
            self.letters = "".join(sorted(set().union(*self.n)))
        places = len(rest) + (longer > 0)
        if len(self.n) <= places * (len(self.letters) if longer >= 0 else 1):
            return [r for r in self.n if one_edit(rest, r)]
        if longer < 0:
            made = {rest[:i] + rest[i + 1 :] for i in range(places)}
        else:
            made = {rest[:i] + c + rest[i + 1 - longer :] for i in range(places) for c in self.letters} - {rest}
        return [r for r in made if r in self.n]


class Shard:
    """An automaton over halves; each leads to the rests of its words by which half it is and the word's length."""

    def __init__(self) -> None:
        self.halves: dict[str, dict[tuple[int, int], _Rests]] = {}
        self.automaton = None

    def hold(self, second: int, word: str, n: int) -> None:
        half = len(word) // 2
        own, rest = (word[half:], word[:half]) if second else (word[:half], word[half:])
        self.halves.setdefault(own, {}).setdefault((second, len(word)), _Rests()).n[rest] = n

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(near word, its n), each once; a word whose first half stands in this one is not found by its second."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half, held in self.halves.items():
                self.automaton.add_word(half, (half, held))
            if self.halves:
                self.automaton.make_automaton()
        size = len(word)
        for last, (half, held) in self.automaton.iter(word) if self.halves else ():
            start = last + 1 - len(half)
            for length in (size - 1, size, size + 1):
                if start == 0 and (rests := held.get((0, length))):
                    for rest in rests.near(word[last + 1 :], length - size):
                        yield half + rest, rests.n[rest]
                if last == size - 1 and (rests := held.get((1, length))):
                    for rest in rests.near(word[:start], length - size):
                        if not word.startswith(rest):
                            yield rest + half, rests.n[rest]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, word, n) by shard, its held words (parts 0 and 1: their half) before those to scan (part 2)."""
    at, shard = None, Shard()
    for batch in batches:
        out: list[tuple] = []
        for number, part, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if number != at:
                at, shard = number, Shard()
            if part < 2:
                shard.hold(part, word, n)
                continue
            near = list(shard.near(word))
            if near:
                best = min((-m, w) for w, m in near)
                out.append((word, len(near), -best[0], best[1]))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, near_n, near): how many of `words` (word, n) are near each that has any, and the most frequent of them.

    Each word must come once and have two characters or more.
    """
    parts, size = default_partitions(words.sparkSession), F.length("word")
    shards = max(parts, -(-2 * words.count() // SHARD))
    key = lambda second, length, half: F.xxhash64(F.lit(second), length, half)
    first = lambda length: F.floor(length / 2).cast("int")
    head = lambda length: key(0, length, F.col("word").substr(F.lit(1), first(length)))
    tail = lambda length: key(1, length, F.col("word").substr(size - (length - first(length)) + 1, length))
    own = F.posexplode(F.array(head(size), tail(size))).alias("part", "key")
    held = words.select("word", "n", own).withColumn("block", F.lit(0).cast("long"))
    lengths = [size - 1, size, size + 1]
    asked = words.select("word", "n", F.explode(F.array_distinct(F.array(*(f(n) for f in (head, tail) for n in lengths)))).alias("key")).withColumn("block", F.lit(0).cast("long"))
    hot = scratch.write(held.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks")))
    if not hot.isEmpty():
        blocks = F.coalesce("blocks", F.lit(1).cast("long"))
        held = held.join(hot, "key", "left").select("word", "n", "part", "key", F.pmod(F.xxhash64("word"), blocks).alias("block"))
        asked = asked.join(hot, "key", "left").select("word", "n", "key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    shard = F.pmod(F.xxhash64("key", "block"), F.lit(shards)).alias("shard")
    rows = held.select(shard, "part", "word", "n").union(asked.select(shard, F.lit(2).alias("part"), "word", "n").distinct())
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "part")
    found = dealt.mapInArrow(_scan_batches, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def variants(words: DataFrame, scratch: Scratch, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), each word once.

    A word's form is its most frequent near word (of equal ones the least), if that is `ratio` times as frequent; its
    root is where its forms lead. Forms grow by `ratio`, so the rounds are few: each doubles the steps taken.
    """
    near = near_words(words, scratch)
    taken = F.col("near_n") >= ratio * F.col("n")
    found = scratch.write(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")))
    now = scratch.write(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, now = now, scratch.write(step)
        scratch.drop(before)
    return found.join(now.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return variants(scratch.write(frequent_words(table(spark, sf_dir, "documents"))), scratch)


#: Near words by what is left when one character goes: of words of one length at the same place, of the longer word all of the shorter.
OP11_SQL = rf"""
{CRC32_STEPS},
run AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1), lambda p: ('0x' || substring(h, 2 * p - 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM run), crc_table
), word AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN crc % {DAMAGE} = 0 THEN substring(run, 1, crc % length(run)) || substring(run, crc % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), less AS MATERIALIZED (SELECT word, n, spot, substring(word, 1, spot - 1) || substring(word, spot + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM word)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM word w LEFT JOIN best USING (word)),
led(word, root) AS (SELECT word, word FROM found UNION ALL SELECT l.word, f.form FROM led l JOIN found f ON f.word = l.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM found f JOIN led l ON l.word = f.word ANTI JOIN found g ON g.word = l.root AND g.form IS NOT NULL
"""
