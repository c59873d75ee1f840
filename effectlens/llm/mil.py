"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded, gated attention
(Ilse, Tomczak and Welling 2018) weighs the encodings, and the document's score comes from their
weighted sum.  Encoder, attention and classifier are learned together from labels of whole documents.

Passages are described by shares of kinds of characters, how words repeat, word length, and hashed
words; all are computed in numpy for a batch of documents at once.

Fitting takes at most about ``docs`` labelled rows (expected, chosen by a hash of their id) of at most
``max_chars`` characters, all passages of each: the only bounds, and they hold for fitting alone.
Their descriptions, not their texts, reach the driver.  Scoring covers every passage of every text.

Edge cases: a null or empty text is one passage without words, and is scored as such.  Without rows of
both labels every score is the share of label 1 (0.5 without any).  A document with several label rows
counts as 1 if any is 1.  Rows are independent; repeated rows give repeated results.  Further columns
are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.llm.neardup import WordHashes, mixed
from effectlens.llm.shared import frugal, slices, small_batches

PASSAGE = 64
BUCKETS = 32
BATCH_BYTES = 1_000_000
CLASSES = ("upper", "lower", "other_letter", "digit", "line", "bar", "bang", "symbol", "rest")
SYMBOLS = "#*$%&<>@\\^~=+"
FEATURES = len(CLASSES) + 5 + BUCKETS


@lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    """The class of each code point; len(CLASSES) for blanks."""
    out = np.full(sys.maxunicode + 1, CLASSES.index("rest"), np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = CLASSES.index({"Lu": "upper", "Ll": "lower"}.get(kind, "other_letter"))
        elif kind[0] == "N":
            out[i] = CLASSES.index("digit")
    for c in SYMBOLS:
        out[ord(c)] = CLASSES.index("symbol")
    out[ord("|")], out[ord("!")] = CLASSES.index("bar"), CLASSES.index("bang")
    for c in " \t\x0b\x0c\r":
        out[ord(c)] = len(CLASSES)
    out[ord("\n")] = CLASSES.index("line")
    return out


def describe(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(passages, features) of all texts in a row, and how many passages each has."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    pieces = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    h = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(first, counts) + nth // PASSAGE
    n = np.bincount(at, minlength=total).astype(float)
    some = np.maximum(n, 1)

    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = char_class()[codes]
    blank = (kinds == len(CLASSES)) | (codes == 10)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    starts = ~blank
    starts[1:] &= blank[:-1]
    heads = begin[(begin < len(codes)) & (lengths > 0)]
    starts[heads] = ~blank[heads]
    # Characters before a text's first word belong to its first passage.
    before = np.cumsum(starts)
    doc = np.repeat(np.arange(len(texts)), lengths)
    base = np.r_[0, before][begin]
    word = np.maximum(before - base[doc] - 1, 0)
    where = np.minimum(first[doc] + word // PASSAGE, (first + pieces - 1)[doc])
    shares = np.bincount(where * (len(CLASSES) + 1) + kinds, minlength=total * (len(CLASSES) + 1)).reshape(total, -1)
    chars = np.maximum(shares.sum(1), 1)

    def distinct(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, places))
        k, p = keys[order], places[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])] if len(k) else np.zeros(0, bool)
        return np.bincount(p[new], minlength=total)

    pair = (at[1:] == at[:-1]) if len(h) else np.zeros(0, bool)
    twice = mixed(h[:-1] + mixed(h[1:]))[pair] if len(h) else h
    pairs = np.bincount(at[1:][pair], minlength=total) if len(h) else np.zeros(total)
    same = np.bincount(at[1:][pair & (h[1:] == h[:-1])], minlength=total) if len(h) else np.zeros(total)
    buckets = np.bincount(at * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    x = np.column_stack(
        [
            shares[:, : len(CLASSES)] / chars[:, None],
            np.where(n > 0, distinct(h, at) / some, 1),
            np.where(pairs > 0, distinct(twice, at[1:][pair] if len(h) else at) / np.maximum(pairs, 1), 1),
            same / some,
            chars / some / 10,
            np.log1p(n) / 4,
            buckets / some[:, None],
        ]
    )
    return x.astype(np.float32), pieces


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, pieces: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z = (x - self.mean) / self.spread
        h = np.maximum(z @ w["encode"] + w["encode_bias"], 0)
        t, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["weigh"]
        doc = np.repeat(np.arange(len(pieces)), pieces)
        start = np.cumsum(pieces) - pieces
        a = np.exp(e - np.maximum.reduceat(e, start)[doc])
        a /= np.add.reduceat(a, start)[doc]
        bag = np.add.reduceat(a[:, None] * h, start)
        logit = bag @ w["judge"] + w["judge_bias"][0]
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "doc": doc, "start": start, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        w, h, t, g, a, doc = self.weights, f["h"], f["t"], f["g"], f["a"], f["doc"]
        d = (f["p"] - y) / len(y)
        to_bag = d[:, None] * w["judge"]
        along = (h * to_bag[doc]).sum(1)
        to_e = a * (along - np.add.reduceat(a * along, f["start"])[doc])
        to_t, to_g = to_e[:, None] * w["weigh"] * g * (1 - t * t), to_e[:, None] * w["weigh"] * t * g * (1 - g)
        to_h = (a[:, None] * to_bag[doc] + to_t @ w["attend"].T + to_g @ w["gate"].T) * (h > 0)
        return {
            "encode": f["z"].T @ to_h, "encode_bias": to_h.sum(0), "attend": h.T @ to_t, "gate": h.T @ to_g,
            "weigh": (t * g).T @ to_e, "judge": f["bag"].T @ d, "judge_bias": np.array([d.sum()]),
        }

    def score(self, x: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        return np.full(len(pieces), self.constant) if self.constant is not None else self.forward(x, pieces)["p"]


def learn(x: np.ndarray, pieces: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Model:
    """Adam on the log loss, in batches of documents."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    shape = {"encode": (FEATURES, hidden), "attend": (hidden, attention), "gate": (hidden, attention), "weigh": (attention,), "judge": (hidden,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()} | {"encode_bias": np.zeros(hidden), "judge_bias": np.zeros(1)}
    model = Model(x.mean(0), x.std(0) + 1e-3, w)
    start = np.cumsum(pieces) - pieces
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            rows = np.concatenate([np.arange(start[i], start[i] + pieces[i]) for i in some])
            grads = model.gradients(model.forward(x[rows], pieces[some]), y[some])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def described(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(columns, passages, x): the packed descriptions of each row's text; columns are names and types before the text."""
    small_batches(rows.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            text = batch.column(len(columns))
            for at, end in slices(text, BATCH_BYTES):
                x, pieces = describe(text.slice(at, end - at).to_pylist(), known)
                cut = np.cumsum([0, *pieces])
                packed = pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(len(pieces))], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, end - at) for i in range(len(columns))], pa.array(pieces, pa.int64()), packed], [*columns, "passages", "x"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns.items()) + ", passages long, x binary")


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, max_chars: int = 60_000) -> Model:
    """Learn from labelled documents; use tells, of the id in labels, whether its label may be seen."""
    known = labels.filter(use & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("double").alias("y"))
    many = known.count()
    if not many:
        return learn(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    grain = 1 << 40
    chosen = known.filter(F.pmod(F.xxhash64("k"), F.lit(grain)) < min(grain, sample * grain // many))
    # About `sample` rows of two numbers: what is broadcast has a bound.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    # Of an id that stands more than once one text, the first in order, so that what is learned from has the sample's bound.
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("k")).groupBy("k", "y").agg(F.min("text").alias("text"))
    got = described(rows.select("k", "y", "text"), {"k": dict(known.dtypes)["k"], "y": "double"}).collect()
    got = sorted(got, key=lambda r: (r.k, r.x))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]) if got else np.zeros((0, FEATURES))
    return learn(x, np.array([r.passages for r in got], np.int64), np.array([r.y for r in got]))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): score is the chance of label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, WordHashes()
        for batch in batches:
            for at, end in slices(batch.column(1), BATCH_BYTES):
                x, pieces = describe(batch.column(1).slice(at, end - at).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(own.score(x, pieces), pa.float64()), pa.array(pieces, pa.int64())], ["id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, passages long").withColumnRenamed("id", id_col)
