"""Language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of WINDOW bytes; each window also sees the
few bytes after it, so every run of up to four bytes of the whole text lies in one window. Bytes are
embedded; filters of widths 2, 3 and 4 slide over them; each filter's maximum goes to a softmax. A
text's answer is the mean of its windows' probabilities, by the bytes they hold.

Training takes a bounded sample: about `per_lang` windows of each language, drawn by a hash from all windows
of all its labelled texts, whatever their length. The driver gets just those windows; with up to a few
hundred languages that is some hundred megabytes at most.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, may_learn, packed, table, unpacked

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Languages that are learned, those of the most text; and labelled windows of each that are learned from, in expectation.
MOST_LANGS = 500
PER_LANG = 3000
UNDETERMINED = "und"
#: The pipeline's class for texts in none of the languages, and labelled windows of a language it learns from. Every
#: HELD-th labelled text is not trained on; that share of those (of each language) stays whatever the network says.
NONE, STAGE_PER_LANG, HELD, KEEP = "", 1500, 5, 0.998
#: Windows that go through the network at once.
BATCH = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW + 3) bytes; zeros fill the last window."""
    n, more = max(1, -(-len(text) // WINDOW)), max(WIDTHS) - 1
    padded = np.zeros(n * WINDOW + more, np.uint8)
    padded[: len(text)] = _LOWER[np.frombuffer(text, np.uint8)]
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW + more), (WINDOW, 1))


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED; row 0 stays zero
    filters: np.ndarray  # (4 * EMBED) x (widths * FILTERS); a narrow filter's last rows stay zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, wins: np.ndarray) -> np.ndarray:
        e = self.embed[wins]
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(wins), WINDOW, max(WIDTHS) * EMBED), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def features(self, wins: np.ndarray) -> np.ndarray:
        response = self._columns(wins).reshape(-1, max(WIDTHS) * EMBED) @ self.filters
        return np.maximum(response.reshape(len(wins), WINDOW, -1).max(axis=1) + self.bias, 0)

    def probabilities(self, wins: np.ndarray) -> np.ndarray:
        found = np.concatenate([self.features(wins[i : i + BATCH]) for i in range(0, len(wins), BATCH)])
        return _softmax(found @ self.out + self.out_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(wins: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 1) -> ByteNet:
    """Adam on the cross-entropy; the maximum passes its gradient to the place it came from."""
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat([[1.0], [0.0]], [w * EMBED, (max(WIDTHS) - w) * EMBED], axis=0).repeat(FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)
    init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = ByteNet(langs, init(256, EMBED), init(max(WIDTHS) * EMBED, total) * mask, np.zeros(total, np.float32), init(total, len(langs)) * 0.5, np.zeros(len(langs), np.float32))
    net.embed[0] = 0
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(labels) / np.maximum(1, np.bincount(labels, minlength=len(langs))) / len(langs)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(wins))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            x, y = wins[take], labels[take]
            columns = net._columns(x)
            response = (columns.reshape(-1, columns.shape[2]) @ net.filters).reshape(len(x), WINDOW, total)
            top = response.argmax(axis=1)
            raw = np.take_along_axis(response, top[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(raw, 0)
            d_out = _softmax(hidden @ net.out + net.out_bias)
            d_out[np.arange(len(x)), y] -= 1
            d_out *= weight[y][:, None] / len(x)
            d_raw = (d_out @ net.out.T) * (raw > 0)
            seen = columns[np.arange(len(x))[:, None], top]  # windows x filters x inputs
            d_filters = np.einsum("nf,nfi->if", d_raw, seen) * mask
            d_seen = (d_raw[:, :, None] * net.filters.T[None]).reshape(len(x), total, max(WIDTHS), EMBED)
            at_bytes = x[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(max(WIDTHS))]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, at_bytes.ravel(), d_seen.reshape(-1, EMBED))
            d_embed[0] = 0
            step += 1
            for p, g, m, v in zip(params, (d_embed, d_filters, d_raw.sum(0), hidden.T @ d_out, d_out.sum(0)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def has_letter(text: bytes) -> bool:
    if any(97 <= b <= 122 or 65 <= b <= 90 for b in text[:64]):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _mean(net: ByteNet, text: bytes) -> np.ndarray:
    """The mean of the windows' probabilities, by the bytes they hold."""
    wins = windows(text)
    held = np.full(len(wins), WINDOW, np.float64)
    held[-1] = len(text) - WINDOW * (len(wins) - 1)
    return held @ net.probabilities(wins) / held.sum()


def predict(net: ByteNet | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; null and letterless texts, and all without a model, are `und` at 0."""
    out = []
    for text in texts:
        if net is None or text is None or not has_letter(text):
            out.append((UNDETERMINED, 0.0))
            continue
        mean = _mean(net, text)
        best = int(mean.argmax())
        out.append((net.langs[best], float(min(1.0, max(0.0, mean[best])))))
    return out


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, found = [], []
        for lang, text, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)):
            text = text.as_py()
            if not has_letter(text):
                continue
            wins = windows(text)
            for i in at.as_py():
                langs.append(lang)
                found.append(wins[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "win"])


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[np.ndarray, list[str]]:
    """Labelled windows and their languages: about `per_lang` of each language, of rows that aren't held out."""
    known = docs.where(may_learn(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(F.col(text_col)) / WINDOW)).cast("long")
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), n.alias("n"))
    share = rows.groupBy("lang").agg((per_lang / F.sum("n")).alias("share"))
    # Languages of the most windows, at most: a dirty column has millions of values.
    few = share.orderBy("share", "lang").limit(MOST_LANGS)
    draw = lambda i: F.pmod(F.xxhash64(F.lit(11), F.col("id"), i), F.lit(1 << 30)) / float(1 << 30)
    at = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: draw(i) < F.col("share"))
    taken = rows.join(F.broadcast(few), "lang").select("lang", "text", at.alias("at")).where(F.size("at") > 0)
    sample = taken.mapInArrow(_cut_windows, "lang string, win binary").toArrow().sort_by([("lang", "ascending"), ("win", "ascending")])
    wins = np.frombuffer(b"".join(sample.column("win").to_pylist()), np.uint8).reshape(sample.num_rows, WINDOW + max(WIDTHS) - 1)
    return wins, sample.column("lang").to_pylist()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> ByteNet | None:
    """A network from rows that aren't held out and name their language; None where there is none."""
    wins, names = _sample(docs, id_col, text_col, lang_col, per_lang)
    if not len(wins):
        return None
    langs = sorted(set(names))
    return train(wins, np.array([langs.index(x) for x in names]), langs)


def _cut(text: bytes, rng: np.random.Generator) -> bytes:
    """A window as it is or, half the time, its start of 12 bytes or more, up to a space where there is one."""
    if rng.random() < 0.5 or len(text) < 24:
        return text
    short = text[: int(np.exp(rng.uniform(np.log(12), np.log(len(text)))))]
    return short[: short.rfind(b" ")] if b" " in short[8:] else short


def _spoilt(text: bytes, alphabets: list[str], rng: np.random.Generator) -> bytes:
    """One window in none of the languages, made from one in a language."""
    words, kind = text.decode("utf-8", "ignore").split() or ["x"], int(rng.integers(8))
    if kind == 0:  # its bytes, shuffled
        return rng.permutation(np.frombuffer(text, np.uint8)).tobytes()
    if kind == 1:  # random letters of the alphabet, as words or as one run
        letters = list(alphabets[int(rng.integers(len(alphabets)))])
        return "".join(" " if rng.random() < 0.15 else str(rng.choice(letters)) for _ in range(WINDOW)).encode()[:WINDOW]
    if kind == 2:  # each word's letters, shuffled
        return " ".join("".join(rng.permutation(list(w))) for w in words).encode()[:WINDOW]
    if kind == 3:  # encoded data
        raw = rng.integers(0, 256, WINDOW, np.uint8).tobytes() if rng.random() < 0.5 else text
        made = (base64.b64encode, base64.b32encode, binascii.hexlify)[int(rng.integers(3))](raw).lower()
        return made[: int(rng.integers(WINDOW // 2, WINDOW + 1))]
    if kind in (4, 5):  # a script at random: letters of one block of code points
        start = int(rng.choice([0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xB80, 0xE00, 0x1200, 0x3040, 0x4E00, 0x6000, 0x8000, 0xAC00, 0xC000]))
        return "".join(" " if rng.random() < 0.15 else chr(start + int(rng.integers(0, 96))) for _ in range(WINDOW // 2)).encode()[:WINDOW]
    # Words as names between marks, as in programs and data.
    name = lambda: str(rng.choice(["_", "", "."])).join(str(w).strip(".,") for w in rng.choice(words, int(rng.integers(1, 3))))
    marks = ["(", ")", "):\n    ", " = ", ";\n", " == ", "[", "]", ", ", ".", " {\n", "}\n", " -> ", "'", '"', " + ", "0", "1", ": ", "<", ">", "/", "\n        ", " -= ", "#"]
    return "".join(name() + "".join(rng.choice(marks, int(rng.integers(1, 4)))) for _ in range(WINDOW // 6)).encode()[:WINDOW]


def _window(text: bytes) -> np.ndarray:
    return windows(text[:WINDOW])[0]


def odd_windows(texts: list[bytes], n: int, rng: np.random.Generator) -> np.ndarray:
    """`n` windows in none of the languages that `texts` are in."""
    alphabets = sorted({"".join(sorted({c for c in t.decode("utf-8", "ignore") if c.isalpha()})) or "x" for t in texts})
    return np.stack([_window(_cut(_spoilt(texts[int(rng.integers(len(texts)))], alphabets, rng), rng)) for _ in range(n)])


@dataclass
class Gate:
    """A network with the class NONE, and the probability of NONE from which a text is rejected."""

    net: ByteNet
    bound: float

    def stays(self, texts: list[bytes | None]) -> list[bool]:
        """Texts with a letter that the network does not give to NONE; null texts go."""
        out, at = [], self.net.langs.index(NONE)
        for text in texts:
            found = None if text is None or not has_letter(text) else _mean(self.net, text)
            out.append(found is not None and bool(found[at] <= self.bound))
        return out


def learn_gate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = STAGE_PER_LANG, seed: int = 5) -> Gate | None:
    """The gate from labelled rows; None where there are none. Of the windows every HELD-th sets the bound."""
    wins, names = _sample(docs, id_col, text_col, lang_col, per_lang)
    if not len(wins):
        return None
    rng, langs = np.random.default_rng(seed), [NONE, *sorted(set(names) - {NONE})]
    texts = [w[:WINDOW].tobytes().rstrip(b"\0") for w in wins]
    labels = np.array([langs.index(x) for x in names])
    held = rng.permutation(len(texts)) % HELD == 0 if len(texts) >= 20 * HELD else np.zeros(len(texts), bool)
    clean = np.stack([_window(_cut(t, rng)) for t in texts])
    own = [t for t, h in zip(texts, held) if not h]
    odd = odd_windows(own, max(2 * int(np.bincount(labels).max()), len(own)), rng)
    net = train(np.concatenate([clean[~held], odd]), np.concatenate([labels[~held], np.zeros(len(odd), np.int64)]), langs)
    bound = 0.5
    for lang in np.unique(labels[held]):
        found = net.probabilities(clean[held & (labels == lang)])[:, 0]
        bound = max(bound, float(np.quantile(found, KEEP)))
    return Gate(net, bound)


def language(text: Column, net: ByteNet | None) -> Column:
    """A struct of lang_pred and score for a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        found = predict(net, texts.cast(pa.binary()).to_pylist())
        langs, scores = zip(*found) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return of.asNondeterministic()(text)  # so that Spark runs it once a row


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row, from the whole text alone.

    Null texts and texts without a letter are `und` at score 0, and so is every row where no model could
    be learned. Repeated rows stay rows; a null id is not held out. An empty table gives no rows.
    """
    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), language(F.col(text_col), net).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")


def op4_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def _flag(of) -> Callable[[Column], Column]:
    """A column of whether `of` holds, for texts in lists."""

    @F.arrow_udf("boolean")
    def flags(texts: pa.Array) -> pa.Array:
        return pa.array(of(texts.cast(pa.binary()).to_pylist()), pa.bool_())

    return flags.asNondeterministic()  # so that Spark runs it once a row


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows stay whose text is in a language, by a network that knows a class for what is in none.

    Null and letterless texts go, and so do random letters, encoded data, program text and scripts that no labelled text
    has. Where nothing can be learned (no label, empty table) texts with a letter stay. Repeated ids and rows
    are judged each by their text.
    """
    gate = learn_gate(docs)
    stays = gate.stays if gate is not None else lambda texts: [t is not None and has_letter(t) for t in texts]
    found = packed(docs, stays=_flag(stays)(F.col("text")))
    return unpacked(found.where("stays"))
