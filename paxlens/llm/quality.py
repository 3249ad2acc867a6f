"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), so the pairwise interactions of all
features cost linear time.  Features are a document's distinct hashed words (weighted alike, norm one half), the values of
``metadata`` columns hashed beside them (none unless asked for), and its structure statistics and length, each as a
standardised value and as its quantile bin.  It is fitted in numpy on a bounded sample of labelled documents (``SAMPLE`` of
each class, by hash order).  What can be counted word by word is counted once for every distinct word a worker meets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, mapped, packed_row, text_column, texts_of
from .toxicity import labelled_sample

BUCKETS, RANK = 1 << 15, 8
SAMPLE = {0: 3000, 1: 5000}  # labelled documents of each class that the fit reads at most
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
BINS = 8
KEPT_WORDS = 150_000  # words kept in a worker (about 25 MB)
SEED = 5
STATISTICS = ("length", "words", "word_length", "distinct", "top_word", "next_same", "pairs", "letters", "digits", "upper", "marks", "pipes", "loud", "lines", "line_repeats", "bare_lines", "short_words", "capital_words", "ends", "long_words")
_LETTERS, _DIGITS, _UPPER = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKS = re.compile(r"[^\w\s.,;:'’\"()!?-]")
_LOUD = re.compile(r"[!?]{2,}")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def word_statistics(w: str) -> tuple:
    """What a word adds to the sums over a text: letters, digits, upper case, marks, pipes, loud runs; short, capital, sentence end, long."""
    n, bare = len(w), w[:-1] if w[-1] in ".,;:!?" else w
    if bare.isalpha():  # letters, and a plain mark at most
        return len(bare), 0, 0 if bare.islower() else len(_UPPER.findall(bare)), 0, 0, 0, n <= 3, bare.istitle(), w[-1] in ".!?", n >= 15
    found = [len(x.findall(w)) for x in (_LETTERS, _DIGITS, _UPPER, _MARKS)]
    return *found, w.count("|"), len(_LOUD.findall(w)), n <= 3, w.istitle(), w[-1] in ".!?", n >= 15


class Features:
    """Texts to (word buckets, statistics); remembers words it has met."""

    def __init__(self, metadata: tuple[str, ...] = ()):
        self.metadata = metadata
        self.at: dict[str, int] = {}
        self.sums = np.zeros((KEPT_WORDS, 10), np.float32)
        self.buckets = np.zeros(KEPT_WORDS, np.int64)

    def places(self, words: list[str]) -> list[int]:
        found = list(map(self.at.get, words))
        if None in found:
            new = [w for w, f in zip(words, found) if f is None]
            if len(self.at) + len(new) > len(self.buckets):
                self.at.clear()
                new = words
                if len(new) > len(self.buckets):  # one text with more distinct words than are kept
                    self.sums, self.buckets = np.zeros((len(new), 10), np.float32), np.zeros(len(new), np.int64)
            start = len(self.at)
            self.sums[start : start + len(new)] = [word_statistics(w) for w in new]
            self.buckets[start : start + len(new)] = [bucket(w.lower()) for w in new]
            self.at.update(zip(new, range(start, start + len(new))))
            found = list(map(self.at.get, words))
        return found

    def __call__(self, text: str | None, values: tuple = ()) -> tuple[np.ndarray, list[float]]:
        """Distinct buckets of the words (and of metadata values), and the statistics in the order of ``STATISTICS``; zeros for empty texts."""
        text = text or ""
        words, chars = text.split(), len(text)
        more = [bucket(f"{c}\0{v}") for c, v in zip(self.metadata, values)]
        if not words:
            return np.unique(np.array(more, np.int64)), [math.log1p(chars)] + [0.0] * (len(STATISTICS) - 1)
        counts = Counter(words)
        at = self.places(list(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        letters, digits, upper, marks, pipes, loud, short, capital, ends, long_ = (times @ self.sums[at]).tolist()
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        stats = [
            math.log1p(chars), math.log1p(n), (chars - n) / n, len(counts) / n, float(times.max()) / n,
            sum(map(str.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, letters / chars, digits / chars, upper / chars,
            marks / n, pipes / n, loud / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
            sum(1 for x in lines if x.rstrip()[-1] not in ".!?") / max(1, len(lines)), short / n, capital / n, ends / n, long_ / n,
        ]
        return np.unique(np.concatenate([self.buckets[at], np.array(more, np.int64)])), stats


@dataclass
class Machine:
    """w0, w, v over word buckets, then standardised statistics, then their bins."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # (statistics, BINS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray
    prior: float = 0.0
    metadata: tuple[str, ...] = ()

    def sparse(self, words: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        s = np.asarray(stats)
        k = len(s)
        binned = (s[:, None] > self.edges).sum(1) + np.arange(k) * BINS
        ids = np.concatenate([words, BUCKETS + np.arange(k), BUCKETS + k + binned])
        value = np.clip((s - self.mean) / self.scale, -4, 4) / math.sqrt(k)
        x = np.concatenate([np.full(len(words), 0.5 / math.sqrt(max(1, len(words)))), value, np.full(k, 1 / math.sqrt(k))])
        return ids, x

    def logit(self, ids: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        total = vx.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * (total @ total - (vx * vx).sum())), total

    def score(self, words: np.ndarray, stats: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(*self.sparse(words, stats))[0] + self.prior))))


    def gradients(self, data: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(features met, gradients of w and v there, gradient of w0) of the weighted mean log loss."""
        all_ids, gw, gv, g0 = [], [], [], 0.0
        for (ids, x), truth, share in zip(data, y, weight):
            z, total = self.logit(ids, x)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - truth) * share / len(data)
            all_ids.append(ids)
            gw.append(g * x)
            gv.append(g * x[:, None] * (total - self.v[ids] * x[:, None]))
            g0 += g
        ids, back = np.unique(np.concatenate(all_ids), return_inverse=True)
        dv = np.zeros((len(ids), self.v.shape[1]))
        np.add.at(dv, back, np.concatenate(gv))
        return ids, np.bincount(back, np.concatenate(gw), len(ids)), dv, g0


def blank(stats: np.ndarray | None = None) -> Machine:
    """A machine before its fit; without statistics one whose scores are all alike."""
    k = len(STATISTICS)
    n = BUCKETS + k + k * BINS
    if stats is None:
        return Machine(np.zeros(k), np.ones(k), np.zeros((k, BINS - 1)), 0.0, np.zeros(n), np.zeros((n, RANK)))
    v = np.random.default_rng(SEED).normal(0, 0.05, (n, RANK))
    return Machine(stats.mean(0), stats.std(0) + 1e-9, np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T, 0.0, np.zeros(n), v)


def fit(rows: list[tuple[np.ndarray, list[float]]], y: np.ndarray) -> Machine:
    """Adagrad with weight decay; both classes weigh alike."""
    m = blank(np.array([s for _, s in rows]))
    rng = np.random.default_rng(SEED + 1)
    data = [m.sparse(*r) for r in rows]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    sw, sv, s0 = np.full(len(m.w), 1e-3), np.full(m.v.shape, 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            ids, dw, dv, g0 = m.gradients([data[i] for i in batch], y[batch], weight[batch])
            dw += DECAY * m.w[ids]
            dv += DECAY * m.v[ids]
            sw[ids] += dw * dw
            sv[ids] += dv * dv
            s0 += g0 * g0
            m.w[ids] -= RATE * 10 * dw / np.sqrt(sw[ids])
            m.v[ids] -= RATE * dv / np.sqrt(sv[ids])
            m.w0 -= RATE * g0 / math.sqrt(s0)
    return m


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: dict[int, int] | None = None, metadata: tuple[str, ...] = ()) -> Machine:
    """Fits on a sample of the labelled documents; without both classes every score is 0.5, or near the one class there is.

    Null texts count as empty; see labelled_sample() for null and repeated ids and odd labels; ``metadata`` names columns of
    ``docs`` whose values become features.
    """
    rows, counts = labelled_sample(docs, labels, "quality", usable, most or SAMPLE, metadata)
    y = np.array([r.y for r in rows], np.int64)
    features = Features(metadata)
    if len(set(y)) < 2:
        m = blank()
        m.prior = 0.0 if not len(y) else (30.0 if y[0] else -30.0)
    else:
        m = fit([features(r.text, tuple(r.more)) for r in rows], y)
        m.prior = float(np.log(counts[1] / counts[0]))  # the fit weighs both classes alike
    m.metadata = metadata
    return m


def scored(docs: DataFrame, model: Machine, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of all columns, or of those to ``keep``) and score, one for each of ``docs``.

    Whole texts, very long ones too; null texts count as empty; repeated rows come back as often; columns of any name are
    safe inside the struct; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    cols = docs.select(packed_row(docs, keep), *text_column(docs, keep), F.array(*(F.col(f"`{c}`").cast("string") for c in model.metadata)).cast("array<string>").alias("more"))

    def run(batches):
        m = sent.value
        features = Features(m.metadata)
        for b in batches:
            yield {"row": b.column("row"), "score": [m.score(*features(t.as_py(), v.as_py())) for t, v in zip(texts_of(b), b.column("more"))]}

    return mapped(cols, run, T.StructType([cols.schema["row"], T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of held-out documents (crc32(doc_id) mod 3 = 1) are never learnt.

    Null and empty texts have the score of no words; a null doc_id is not held out and has no label; repeated rows and ids
    come back as often; an empty table gives no rows; no labels give the score 0.5; other columns are ignored.
    """
    model = train(docs, labels, crc_of_id() % 3 != 1)
    out = scored(docs, model, ("doc_id",)).select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose quality score is ``least`` or more, with all their columns.

    Every label is used.  Null and empty texts have the score of no words; repeated rows share their fate; rows with null ids
    are scored like others; columns may have any names; an empty table gives no rows.
    """
    return scored(docs, train(docs, labels, F.lit(True))).where(F.col("score") >= least).select("row.*")
