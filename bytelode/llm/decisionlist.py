"""Quality rules as a learned decision list: ordered conjunctions of thresholds on text statistics.

Sequential covering: a rule is grown test by test, by the information it gains on two thirds of the rows that no
rule covers yet, and pruned from its end by its precision on the last third; of the rules for either
verdict the more precise one goes to the list, its rows are covered, and the next is grown. Rows that no rule covers get
what most of them are. The list becomes one Spark expression, a chain of conditions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import may_learn, table

#: Labelled rows that are learned from, in expectation.
MAX_ROWS = 20_000
#: A list's rules, a rule's tests, thresholds of a statistic, and rows a rule must cover.
MOST_RULES, MOST_TESTS, CUTS, LEAST_COVER = 16, 4, 64, 8
#: A rule must be right so often among the rows it covers.
PRECISION = 0.8
#: The base rules: words at least, and the share of words in repeated windows in per cent at most.
LEAST_WORDS, MOST_REPEATS = 50, 50

BASE = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
SHARES = "chars_a_word symbols_a_word dup_line_share repeat_share".split()
#: The number of words is a base count already.
_TAKEN = [k for k, s in enumerate(quality.STATISTICS) if s not in BASE]
STATISTICS = SHARES + [quality.STATISTICS[k] for k in _TAKEN]
_SPACE = list(b"\t\n\v\f\r ")
_SYMBOLS = list(b"#*$%&|<>")
_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that start a character


def repeat_words(words: list) -> int:
    """Words that are in a window of three that stands in the list twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again, inside = times[place] > 1, np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def base_counts(text: bytes | None) -> list[int]:
    """The values of BASE; null text has none."""
    text = text or b""
    words, held, seen, again = text.split(), np.bincount(np.frombuffer(text, np.uint8), minlength=256), set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return [len(words), int(held[_FIRST].sum() - held[_SPACE].sum()), int(held[_SYMBOLS].sum()), again, repeat_words(words)]


def shares(base: list[int], text: bytes | None) -> list[float]:
    n_words, chars, symbols, again, repeats = base
    words = max(1, n_words)
    return [chars / words, symbols / words, again / (1 + (text or b"").count(b"\n")), repeats / words]


def counts_of(text: Column) -> Column:
    """A struct of BASE (long) and STATISTICS (double) for a text column."""
    names = [*BASE, *STATISTICS]

    @F.arrow_udf(", ".join([f"{b} long" for b in BASE] + [f"{s} double" for s in STATISTICS]))
    def of(texts: pa.Array) -> pa.Array:
        counts, values = [], []
        for t in texts.cast(pa.binary()):
            t = t.as_py()
            counts.append(base_counts(t))
            found = quality.statistics(t)
            values.append(shares(counts[-1], t) + [found[k] for k in _TAKEN])
        ints, floats = np.array(counts, np.int64).reshape(-1, len(BASE)), np.array(values, np.float64).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([*(pa.array(ints[:, k]) for k in range(len(BASE))), *(pa.array(floats[:, k]) for k in range(len(STATISTICS)))], names)

    return of.asNondeterministic()(text)  # so that Spark runs it once a row


def base_failed(at) -> Column:
    """Whether the base rules reject a row; `at` gives the column of a count's name."""
    return (at("n_words") < LEAST_WORDS) | (100 * at("n_repeat_words") > MOST_REPEATS * at("n_words"))


@dataclass
class Rule:
    """A verdict for rows on which all tests hold: (statistic, above, threshold)."""

    verdict: int
    tests: list[tuple[int, bool, float]] = field(default_factory=list)

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, at in self.tests:
            out &= x[:, i] > at if above else x[:, i] <= at
        return out

    def column(self, stat) -> Column:
        return reduce(and_, (stat(STATISTICS[i]) > at if above else stat(STATISTICS[i]) <= at for i, above, at in self.tests))

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[i]} {'>' if above else '<='} {at:.6g}" for i, above, at in self.tests) + f" -> {self.verdict}"


@dataclass
class DecisionList:
    rules: list[Rule]
    default: int

    def decide(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.default)
        for rule in reversed(self.rules):
            out[rule.holds(x)] = rule.verdict
        return out

    def _chain(self, values: list, default, stat) -> Column:
        found = None
        for rule, value in zip(self.rules, values):
            found = F.when(rule.column(stat), value) if found is None else found.when(rule.column(stat), value)
        return F.lit(default) if found is None else found.otherwise(default)

    def verdict(self, stat) -> Column:
        """The first rule's verdict that holds, as a chain of conditions."""
        return self._chain([r.verdict for r in self.rules], self.default, stat)

    def place(self, stat) -> Column:
        """That rule's place in the list, from 1; 0 where none holds."""
        return self._chain(list(range(1, len(self.rules) + 1)), 0, stat)


def _grow(x: np.ndarray, hit: np.ndarray, cuts: list[np.ndarray], verdict: int) -> Rule:
    """Adds the test of most information gained until only hits are covered, or nothing is gained."""
    rule, rows = Rule(verdict), np.arange(len(x))
    while len(rule.tests) < MOST_TESTS and not hit[rows].all():
        p0, n0 = hit[rows].sum(), len(rows)
        best = (1e-9, None)
        for i, at in enumerate(cuts):
            if not len(at):
                continue
            code = np.searchsorted(at, x[rows, i])  # code <= k exactly if value <= at[k]
            p, n = (np.bincount(code, w, len(at) + 1).cumsum()[:-1] for w in (hit[rows].astype(float), np.ones(len(rows))))
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = np.where((pp > 0) & (nn >= LEAST_COVER), pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(nn, 1)) - np.log2(p0 / n0)), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), (i, above, float(at[gain.argmax()])))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        i, above, at = best[1]
        rows = rows[x[rows, i] > at] if above else rows[x[rows, i] <= at]
    return rule


def _worth(rule: Rule, x: np.ndarray, hit: np.ndarray) -> tuple[float, int]:
    """Precision with one row for and one against it, and rows covered."""
    inside = rule.holds(x)
    return (hit[inside].sum() + 1) / (inside.sum() + 2), int(inside.sum())


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> DecisionList:
    """The list for STATISTICS `x` and labels 0 or 1. Without rows, or rows of one kind, it has no rules; no row: keep."""
    if not len(y) or y.min() == y.max():
        return DecisionList([], int(y[0]) if len(y) else 1)
    rng, rules = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 1)[1:-1])) for i in range(x.shape[1])]
    left = np.arange(len(y))
    while len(rules) < MOST_RULES and len(left) >= LEAST_COVER and y[left].min() != y[left].max():
        shuffled = rng.permutation(left)
        grow, prune = np.sort(shuffled[: len(left) * 2 // 3]), np.sort(shuffled[len(left) * 2 // 3 :])
        best = None
        for verdict in (0, 1):
            rule = _grow(x[grow], y[grow] == verdict, cuts, verdict)
            shorter = [Rule(verdict, rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
            if not shorter:
                continue
            rule = max(shorter, key=lambda r: (_worth(r, x[prune], y[prune] == r.verdict)[0], -len(r.tests)))
            worth = _worth(rule, x[left], y[left] == verdict)
            if worth[1] >= LEAST_COVER and worth[0] >= PRECISION and (best is None or worth > best[0]):
                best = (worth, rule)
        if best is None:
            break
        rules.append(best[1])
        left = left[~best[1].holds(x[left])]
    rest = y[left] if len(left) else y
    return DecisionList(rules, int(2 * rest.sum() >= len(rest)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DecisionList:
    """Learns from labelled documents that pass the base rules and aren't held out, about `max_rows` by a hash of their ids.

    Null labels teach nothing, repeated rows once. Only those rows' statistics come to the driver, some megabytes.
    """
    known = labels.where(may_learn(F.col(id_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    rows = own.join(F.broadcast(few), F.col("_own") == F.col("_id")).select("_id", "_label", counts_of(F.col("_text")).alias("c"))
    got = rows.where(~base_failed(lambda name: F.col(f"c.{name}"))).select("_id", "_label", "c.*").distinct().toArrow()
    got = got.sort_by([("_id", "ascending"), ("_label", "ascending"), ("n_bytes", "ascending"), ("n_symbols", "ascending")])
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], 1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, got.column("_label").to_numpy().astype(np.int64))


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, BASE ..., base_failed, kept, rule) for every row, from its whole text alone.

    Null text counts as empty, which the base rules reject. `rule` is the place of the rule that decided, 0 for the
    list's last word, null where the base rules did. Repeated rows and null ids stay rows. An empty table gives no rows;
    other columns are not read.
    """
    at = lambda name: F.col(f"c.{name}")
    counted = docs.select(F.col(id_col), counts_of(F.col(text_col)).alias("c"))
    found = counted.select(id_col, *(at(b) for b in BASE), base_failed(at).alias("base_failed"), rules.verdict(at).alias("v"), rules.place(at).alias("r"))
    return found.select(id_col, *BASE, "base_failed", (~F.col("base_failed") & (F.col("v") == 1)).alias("kept"), F.when(~F.col("base_failed"), F.col("r")).alias("rule"))


def op13_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))
