"""Exact substring search over a table of texts for a set of patterns.

Matches overlap, offsets are bytes from 0, an empty pattern matches at each of the N + 1 places, and a
pattern that holds the byte 0 matches nowhere. Null texts give no rows. Texts are read once, whatever the
number of patterns (those of a table over 128 bytes are held against texts that are read again): a stated query set goes to the tasks, a DataFrame of patterns (and a stated set of more than
MOST_PATTERNS) stays a table that the texts' windows meet by hash (windows.py). Pattern ids are integers, or of
whatever type the DataFrame or mapping that names the patterns has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.bytes import as_bytes, ascii_lower, byte_text, has_border, holds, literal_occurrences
from ..functions.sql import places
from ..plans.patterns import FEW, FOLD, MOST_PATTERNS, Patterns, pattern_list
from . import windows

#: Rows that a Python task sends at once.
SEND = 1_000_000


def _texts(docs: DataFrame, id_col: str, text_col: str, ci: bool, encoding: str = "latin-1") -> DataFrame:
    text = F.col(text_col) if encoding == "utf-8" else byte_text(F.col(text_col))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), (ascii_lower(text) if ci else text).alias("text"))


def _encoding(docs: DataFrame, text_col: str, wanted: list[tuple]) -> str:
    """"utf-8" where STRINGs can be searched as they are, else "latin-1": a character for each byte."""

    def whole(p: bytes) -> bool:
        try:
            return bool(p.decode()) or not p
        except UnicodeDecodeError:
            return False

    return "utf-8" if isinstance(docs.schema[text_col].dataType, StringType) and all(whole(p) for _, p in wanted) else "latin-1"


def _each(wanted: list[tuple], value) -> Column:
    return F.array(*(F.struct(F.lit(i).cast("long").alias("pattern_id"), value(p).alias("value")) for i, p in wanted))


class _Names:
    """Scans work with integers: a set's own where they are, else places in it that `back` turns into ids."""

    def __init__(self, spark: SparkSession, patterns: Patterns, ci: bool):
        self.spark, self.wanted = spark, pattern_list(patterns, ci)
        kind = patterns.schema[0].dataType if isinstance(patterns, DataFrame) else None
        own = isinstance(kind, IntegralType) if kind is not None else all(isinstance(i, int) for i, _ in self.wanted)
        self.names = None
        if not own or any(i is None for i, _ in self.wanted):
            ids = [i for i, _ in self.wanted]
            kind = kind.simpleString() if kind is not None else "string"
            self.names = spark.createDataFrame(list(enumerate(ids)), f"_place long, _name {kind}")
            self.wanted = [(k, p) for k, (_, p) in enumerate(self.wanted)]

    def back(self, found: DataFrame) -> DataFrame:
        if self.names is None:
            return found
        named = found.join(F.broadcast(self.names), F.col("pattern_id") == F.col("_place"))  # a row for each pattern of the stated set
        return named.select(*(F.col("_name").alias(c) if c == "pattern_id" else F.col(c) for c in found.columns))


def _automaton(wanted: list[tuple]):
    ids: dict[bytes, list[int]] = {}
    for i, p in wanted:
        if p and b"\0" not in p:
            ids.setdefault(p, []).append(i)
    found = ahocorasick.Automaton()
    for p, of in ids.items():
        found.add_word(p.decode("latin-1"), (len(p), of))
    if ids:
        found.make_automaton()
    return found


#: The last automata that a worker has built, by query set.
_built: dict[str, object] = {}


def _automaton_of(key: str, sent):
    if key not in _built:
        while len(_built) > 3:
            _built.pop(next(iter(_built)))
        _built[key] = _automaton(sent.value)
    return _built[key]


def _sent(spark: SparkSession, wanted: list[tuple]):
    """A worker reads the patterns and builds its automaton once, not for each batch."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(wanted)


def _places(text: str, pattern: str) -> np.ndarray:
    """Where a pattern stands, overlapping itself or not."""
    if not pattern:
        return np.arange(len(text) + 1)
    if not has_border(pattern.encode("latin-1")):
        pieces = text.split(pattern)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(pattern)
        return np.cumsum(sizes[:-1]) - len(pattern)
    at, out = text.find(pattern), []
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return np.array(out, np.int64)


class _Rows:
    """(row, pattern_id, value) triples that go out in batches."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.n = 0

    def add(self, row: int, ids, values) -> None:
        values = np.asarray(values, np.int64)
        self.rows.append(np.full(len(values), row))
        self.ids.append(np.broadcast_to(np.asarray(ids, np.int64), len(values)))
        self.values.append(values)
        self.n += len(values)

    def batch(self, of: pa.Array) -> pa.RecordBatch:
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        out = pa.RecordBatch.from_arrays([of.take(join(self.rows)), join(self.ids), join(self.values)], ["id", "pattern_id", "value"])
        self.__init__()
        return out


def _as_text(data: bytes, ci: bool) -> str:
    """A character for each byte."""
    return (data.translate(FOLD) if ci else data).decode("latin-1")


def _scan(spark: SparkSession, wanted: list[tuple], places: bool, ci: bool):
    """Rows of (id, pattern_id, place) or, without places, of counts, from one pass over each text's bytes."""
    key, sent = _sent(spark, wanted)
    few = len(wanted) <= FEW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [i for i, p in sent.value if not p]
        single = [(i, p.decode("latin-1")) for i, p in sent.value if b"\0" not in p] if few and places else None
        automaton = _automaton_of(key, sent) if single is None else None
        for batch in batches:
            out = _Rows()
            for row, text in enumerate(batch.column(1)):
                text = _as_text(text.as_py(), ci)
                if single is not None:
                    for i, p in single:
                        out.add(row, i, _places(text, p))
                elif places:
                    found = [(i, last + 1 - size) for last, (size, of) in automaton.iter(text) for i in of] if len(automaton) else []
                    if found:
                        out.add(row, *zip(*found))
                    for i in empty:
                        out.add(row, i, np.arange(len(text) + 1))
                else:
                    n: dict[int, int] = {}
                    if len(automaton):
                        for _, (_, of) in automaton.iter(text):
                            for i in of:
                                n[i] = n.get(i, 0) + 1
                    for i in empty:
                        n[i] = len(text) + 1
                    if n:
                        out.add(row, list(n), list(n.values()))
                if out.n > SEND:
                    yield out.batch(batch.column(0))
            yield out.batch(batch.column(0))

    return run


def _scanned(docs: DataFrame, wanted: list[tuple], places: bool, ci: bool, id_col: str, text_col: str, name: str) -> DataFrame:
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), as_bytes(F.col(text_col)).alias("text"))
    kind = texts.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(_scan(texts.sparkSession, wanted, places, ci), f"id {kind}, pattern_id long, value long")
    return found.select(F.col("id").alias(id_col), "pattern_id", F.col("value").alias(name))


def _as_table(spark: SparkSession, patterns: Patterns) -> tuple[Patterns, DataFrame | None]:
    """The stated query set, or the table that patterns are or are better held as."""
    if isinstance(patterns, DataFrame):
        return patterns, patterns
    stated = list(patterns.items()) if isinstance(patterns, Mapping) else list(enumerate(patterns))
    if len(stated) <= MOST_PATTERNS:
        return dict(stated), None
    kind = "long" if all(isinstance(i, int) for i, _ in stated) else "string"
    rows = pa.table({"id": pa.array([i for i, _ in stated], pa.int64() if kind == "long" else pa.string()), "pattern": pa.array([p.encode() if isinstance(p, str) else p for _, p in stated], pa.binary())})
    return patterns, spark.createDataFrame(rows)


def count(docs: DataFrame, patterns: Patterns, ci: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern_id, n_matches) where a pattern occurs in a text at all."""
    patterns, table = _as_table(docs.sparkSession, patterns)
    if table is not None:
        found = windows.occurrences(windows.texts_of(docs, F.col(id_col), text_col), windows.prepare(table, ci), False, ci)
        return found.groupBy(F.col("key").alias(id_col), "pattern_id").agg(F.sum("value").alias("n_matches"))
    names = _Names(docs.sparkSession, patterns, ci)
    encoding = _encoding(docs, text_col, names.wanted)
    texts = _texts(docs, id_col, text_col, ci, encoding)
    if not names.wanted:
        return names.back(texts.select(id_col, F.lit(0).cast("long").alias("pattern_id"), F.lit(0).cast("long").alias("n_matches")).limit(0))
    if len(names.wanted) > FEW:
        return names.back(_scanned(docs, names.wanted, False, ci, id_col, text_col, "n_matches"))
    found = texts.select(id_col, F.explode(_each(names.wanted, lambda p: literal_occurrences(F.col("text"), p, encoding))).alias("m"))
    return names.back(found.where("m.value > 0").select(id_col, "m.pattern_id", F.col("m.value").alias("n_matches")))


def total_counts(docs: DataFrame, patterns: Patterns, ci: bool = False, by: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by ..., pattern_id, n_matches) over all texts; patterns without a match have no row."""
    keep = F.struct(F.col(id_col), *(by or []))
    patterns, table = _as_table(docs.sparkSession, patterns)
    if table is not None:
        own = F.struct(*(F.col(c) for c in by)) if by else F.lit(0)
        found = windows.occurrences(windows.texts_of(docs, own, text_col), windows.prepare(table, ci), False, ci, by or [])
        return found.groupBy(*(F.col(f"key.{c}").alias(c) for c in by or []), "pattern_id").agg(F.sum("value").alias("n_matches"))
    found = count(docs.select(keep.alias("key"), F.col(text_col).alias("text")), patterns, ci, "key")
    return found.groupBy(*(F.col(f"key.{c}").alias(c) for c in by or []), "pattern_id").agg(F.sum("n_matches").alias("n_matches"))


def contains(docs: DataFrame, patterns: Patterns, ci: bool = False, how: str = "pairs", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which texts hold which patterns.

    `how`: "pairs" gives (id, pattern_id); "semi" the rows of `docs` that hold any, "anti" those that hold
    none (null texts among them).
    """
    patterns, table = _as_table(docs.sparkSession, patterns)
    if table is not None:
        return _table_contains(docs, table, ci, how, id_col, text_col)
    names = _Names(docs.sparkSession, patterns, ci)
    wanted, encoding = names.wanted, _encoding(docs, text_col, names.wanted)
    if how == "pairs":
        texts = _texts(docs, id_col, text_col, ci, encoding)
        if len(wanted) > FEW:
            return names.back(_scanned(docs, wanted, False, ci, id_col, text_col, "n").drop("n"))
        each = _each(wanted, lambda p: holds(F.col("text"), F.lit(p.decode(encoding)))) if wanted else F.array().cast("array<struct<pattern_id:bigint,value:boolean>>")
        return names.back(texts.select(id_col, F.explode(each).alias("m")).where("m.value").select(id_col, "m.pattern_id"))
    if how not in ("semi", "anti"):
        raise ValueError("how is pairs, semi or anti")
    # One look-up for each text that stops at the first hit; no join.
    found = _any(docs.sparkSession, wanted, F.col(text_col), encoding, ci)
    return docs.where(found if how == "semi" else ~found)


def _table_contains(docs: DataFrame, table: DataFrame, ci: bool, how: str, id_col: str, text_col: str) -> DataFrame:
    ready = windows.prepare(table, ci)
    if how == "pairs":
        return windows.occurrences(windows.texts_of(docs, F.col(id_col), text_col), ready, False, ci).select(F.col("key").alias(id_col), "pattern_id").distinct()
    if how not in ("semi", "anti"):
        raise ValueError("how is pairs, semi or anti")
    # Texts are told apart by 128 bits of hashes of their bytes.
    text = as_bytes(F.col(text_col))
    told = F.struct(F.xxhash64(F.lit(3), text).alias("h1"), F.xxhash64(F.lit(4), text).alias("h2"))
    held = windows.occurrences(windows.texts_of(docs, told, text_col), ready, False, ci).select("key.h1", "key.h2").distinct()
    own = docs.select(F.struct("*").alias("row"), F.when(F.col(text_col).isNotNull(), told).alias("told"))
    same = (own["told.h1"] == held["h1"]) & (own["told.h2"] == held["h2"])
    return own.join(held, same, "left_semi" if how == "semi" else "left_anti").select("row.*")


def _any(spark: SparkSession, wanted: list[tuple], text: Column, encoding: str, ci: bool) -> Column:
    if len(wanted) <= FEW:
        own = text if encoding == "utf-8" else byte_text(text)
        own = ascii_lower(own) if ci else own
        return F.coalesce(reduce(Column.__or__, (holds(own, F.lit(p.decode(encoding))) for _, p in wanted), F.lit(False)), F.lit(False))
    key, sent = _sent(spark, wanted)

    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        automaton, always = _automaton_of(key, sent), any(not p for _, p in sent.value)
        found = (t is not None and (always or (len(automaton) > 0 and next(automaton.iter(_as_text(t, ci)), None) is not None)) for t in texts.to_pylist())
        return pa.array(list(found), pa.bool_())

    return of(as_bytes(text))


def _places_of(pattern: bytes) -> Column:
    """The places of a known pattern in the byte text of the column `text`."""
    if not pattern or b"\0" in pattern:
        return F.sequence(F.lit(0).cast("long"), F.length("text").cast("long")) if not pattern else F.array().cast("array<bigint>")
    return F.expr(places("text", f"decode(X'{pattern.hex()}', 'ISO-8859-1')", None if has_border(pattern) else len(pattern)))


def locate(docs: DataFrame, patterns: Patterns, ci: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern_id, pos): a row for each occurrence, overlapping ones too."""
    patterns, table = _as_table(docs.sparkSession, patterns)
    if table is not None:
        found = windows.occurrences(windows.texts_of(docs, F.col(id_col), text_col), windows.prepare(table, ci), True, ci)
        return found.select(F.col("key").alias(id_col), "pattern_id", F.col("value").alias("pos"))
    names = _Names(docs.sparkSession, patterns, ci)
    if not names.wanted or len(names.wanted) > FEW:
        return names.back(_scanned(docs, names.wanted, True, ci, id_col, text_col, "pos"))
    found = _texts(docs, id_col, text_col, ci).select(id_col, F.explode(_each(names.wanted, _places_of)).alias("m"))
    return names.back(found.select(id_col, "m.pattern_id", F.explode("m.value").alias("pos")))


def locate_all(docs: DataFrame, patterns: Patterns, ci: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern_id, positions) with the positions of each match in text order."""
    found = locate(docs, patterns, ci, id_col, text_col)
    return found.groupBy(id_col, "pattern_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def text_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.octet_length(as_bytes(F.col(text_col))).cast("long").alias("text_len"))
