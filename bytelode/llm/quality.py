"""Quality classifier: a sparse rule ensemble (Friedman and Popescu 2008) over text statistics.

Shallow boosted trees give conjunctive rules (the paths to their nodes), a lasso-penalised logistic
regression keeps few of them, and those kept become one Spark column expression. Statistics come from
whole texts, in Arrow batches. Training takes `MAX_ROWS` labelled rows at most in expectation, chosen
by a hash of their ids; only their statistics come to the driver, some megabytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, may_learn, table

MAX_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST_LEAF = 40, 3, 32, 0.3, 10
#: Weight of the lasso penalty, and gradient steps.
LASSO, STEPS = 0.0008, 400
ACCEPT = 0.7

STATISTICS = (
    "n_bytes n_words word_bytes upper_share digit_share punctuation_share symbol_share exclamations bars "
    "non_ascii_share line_words distinct_words repeated_next distinct_lines symbol_words"
).split()
_CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (_b < 128 and _c.isalpha(), _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _b < 128 and _c.isprintable() and not _c.isalnum() and _c != " ", _c in "#$%&*<>{}\\^~@=+_|", _c == "!", _b >= 128)
_SYMBOL_END = frozenset(b"#$%&*!|")


def statistics(text: bytes | None) -> list[float]:
    """The values of STATISTICS; null text counts as empty."""
    text = text or b""
    letters, upper, digits, punctuation, symbols, marks, high = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    words, lines = text.split(), text.split(b"\n")
    size, n = max(1, len(text)), max(1, len(words))
    return [
        len(text), len(words), len(text) / n, upper / max(1.0, letters), digits / size, punctuation / size, symbols / size, marks / n, text.count(b"|") / n,
        high / size, n / len(lines), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), sum([w[-1] in _SYMBOL_END for w in words]) / n,
    ]


def statistics_of(text: Column) -> Column:
    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def of(texts: pa.Array) -> pa.Array:
        found = [statistics(t.as_py()) for t in texts.cast(pa.binary())]
        values = np.array(found, np.float64).reshape(len(found), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(STATISTICS))], STATISTICS)

    return of.asNondeterministic()(text)  # so that Spark runs it once a row


@dataclass
class RuleEnsemble:
    """score = logistic(bias + weights of the rules that hold); a rule is (statistic, above, threshold) tests."""

    bias: float
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + holds(self.rules, x) @ np.array(self.weights))))

    def column(self, stat) -> Column:
        """The score as a Spark expression; `stat` gives the column of a statistic's name."""
        parts = [F.lit(self.bias)]
        for rule, weight in zip(self.rules, self.weights):
            tests = [stat(STATISTICS[i]) > at if above else stat(STATISTICS[i]) <= at for i, above, at in rule]
            parts.append(F.when(reduce(and_, tests), weight).otherwise(0.0))
        return 1 / (1 + F.exp(-reduce(add, parts)))


def holds(rules: list, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for r, rule in enumerate(rules):
        for i, above, at in rule:
            out[:, r] *= x[:, i] > at if above else x[:, i] <= at
    return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, features: np.ndarray, path: tuple, rules: set) -> None:
    """Splits `rows` by the best gain, down to DEPTH; adds each node's path to `rules`."""
    if path:
        rules.add(path)
    best = (1e-9, None)
    g, h = gradient[rows], weight[rows]
    if len(path) < DEPTH:
        for f in features:
            sums = [np.bincount(codes[rows, f], w, len(cuts[f]) + 1).cumsum() for w in (g, h, np.ones(len(rows)))]
            (gl, hl, nl), (gt, ht, nt) = (s[:-1] for s in sums), (s[-1] for s in sums)
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        return
    f, cut = best[1]
    low = codes[rows, f] <= cut
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _grow(codes, cuts, gradient, weight, part, features, tuple(sorted({*path, (int(f), above, float(cuts[f][cut]))})), rules)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1)  # code <= k exactly if value <= cuts[k]
    total, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        grown: set = set()
        _grow(codes, cuts, y - p, p * (1 - p), rows, features, (), grown)
        leaves = [r for r in grown if not any(set(r) < set(o) for o in grown)]
        inside = holds(leaves, x) if leaves else np.zeros((len(y), 0))
        for k in range(len(leaves)):
            at = inside[:, k] > 0
            total[at] += SHRINK * (y - p)[at].sum() / ((p * (1 - p))[at].sum() + 1)
        rules |= grown
    return sorted(rules)


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """The ensemble for statistics `x` and labels 0 or 1; a constant where a class is missing."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return RuleEnsemble(float(np.log(prior / (1 - prior))))
    rules = extract_rules(x, y)
    z = holds(rules, x)
    spread = z.std(axis=0)
    rules, z = [r for r, s in zip(rules, spread) if s > 1e-6], z[:, spread > 1e-6] / spread[spread > 1e-6]
    spread = spread[spread > 1e-6]
    size = 4 / max(1e-9, np.linalg.norm(z - z.mean(0), 2) ** 2 / len(y) + 1)
    w = ahead = np.zeros(z.shape[1])
    b = b_ahead = float(np.log(prior / (1 - prior)))
    t = 1.0
    centre = z.mean(0)
    for _ in range(STEPS):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-(b_ahead + (z - centre) @ ahead))) - y
        new = ahead - size * ((z - centre).T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - size * LASSO, 0)
        new_b, new_t = b_ahead - size * error.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    kept = np.flatnonzero(w)
    return RuleEnsemble(float(b - centre @ w), [rules[i] for i in kept], [float(w[i] / spread[i]) for i in kept])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Learns from labelled rows that aren't held out; null labels teach nothing, repeated ones once."""
    known = labels.where(may_learn(F.col(id_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit(13), "_id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.where(draw < share)  # about max_rows rows of 12 bytes
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    rows = own.join(F.broadcast(few), F.col("_own") == F.col("_id")).select("_id", "_label", statistics_of(F.col("_text")).alias("s"))
    got = rows.select("_id", "_label", "s.*").toArrow().sort_by([("_id", "ascending"), ("_label", "ascending"), ("n_bytes", "ascending")])
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], 1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, got.column("_label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row, from its whole text alone.

    Null text counts as empty text; without labels of both kinds all scores are one constant. Repeated
    rows stay rows; a null id is not held out. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), statistics_of(F.col(text_col)).alias("s"))
    scored = rows.select(id_col, model.column(lambda name: F.col(f"s.{name}")).alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def op2_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
