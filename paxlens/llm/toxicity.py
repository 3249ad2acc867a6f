"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the mean of hashed embeddings of the word and of its first letters; filters of several widths slide
over the words, each keeps its largest response over the whole text (max pooling), and a logistic layer scores.  It is
fitted on a bounded sample of labelled documents (``SAMPLE`` of each class, by hash order); scores are corrected to the
labels' true proportions.  Thresholds for filtering are calibrated by language on all labelled documents apart from the
fitted ones, from histograms of their scores; language is no input of the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, mapped, packed_row, text_column, texts_of, written

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 16
PREFIXES = (4, 5)
SAMPLE = {1: 2500, 0: 5000}  # labelled documents of each class that the fit reads at most
EPOCHS, BATCH, RATE = 8, 32, 0.01
LEAST_STEPS = 400  # of a fit, however few documents there are
KEEP = 0.5  # share of words that a step of the fit sees
KEPT_WORDS = 60_000  # projected words kept in a worker (about 25 MB)
CHUNK = 1 << 13  # words pooled at once
SEED = 3
MARKS = ".,;:!?()[]\"'*#$%&"
PRECISION = 0.95  # aimed at by the thresholds by language
SCORE_BINS = 1000  # of the histograms behind the thresholds
LEAST_TOXIC = 10  # toxic documents of a language that has a threshold of its own


def word_ids(word: str) -> tuple[int, ...]:
    """Buckets of a word without the marks around it, and of its first bytes."""
    raw = (word.strip(MARKS) or word).encode("utf-8", "surrogatepass")
    return crc32(raw) % BUCKETS, crc32(raw[: PREFIXES[0]], 1) % BUCKETS, crc32(raw[: PREFIXES[1]], 2) % BUCKETS


def text_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Convolution:
    """Parameters, and the fit by Adam."""

    emb: np.ndarray
    taps: np.ndarray  # (sum of widths, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    prior: float = 0.0  # added to the log odds
    fitted: list = field(default_factory=list)  # ids that the fit read

    @classmethod
    def new(cls) -> Convolution:
        rng = np.random.default_rng(SEED)
        taps = rng.normal(0, 0.4, (sum(WIDTHS), SIZE, FILTERS))
        return cls(rng.normal(0, 0.05, (BUCKETS, SIZE)), taps, np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, len(WIDTHS) * FILTERS + 1))

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the words, and where it was."""
        vec = self.emb[ids].mean(1) if len(ids) else np.zeros((0, SIZE))
        best, at, tap = [], [], 0
        for k, width in enumerate(WIDTHS):
            own = np.vstack([vec, np.zeros((max(0, width - len(vec)), SIZE))])  # short texts are padded
            conv = sum(own[j : len(own) - width + 1 + j] @ self.taps[tap + j] for j in range(width))
            where = conv.argmax(0)
            best.append(conv[where, np.arange(FILTERS)] + self.bias[k * FILTERS : (k + 1) * FILTERS])
            at.append(where)
            tap += width
        return np.concatenate(best), np.concatenate(at)

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss, by parameter."""
        grad = {n: np.zeros_like(getattr(self, n)) for n in ("emb", "taps", "bias", "out")}
        for ids, truth, share in zip(texts, labels, weight):
            raw, at = self.pooled(ids)
            act = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ self.out[:-1] + self.out[-1], -30, 30)))
            g = (p - truth) * share / len(texts)
            grad["out"][:-1] += g * act
            grad["out"][-1] += g
            d = g * self.out[:-1] * (raw > 0)
            grad["bias"] += d
            tap = 0
            for w, width in enumerate(WIDTHS):
                f = slice(w * FILTERS, (w + 1) * FILTERS)
                live = np.flatnonzero(d[f])
                for j in range(width):
                    pos = at[f][live] + j
                    ok = pos < len(ids)
                    use, pos = live[ok], pos[ok]
                    if len(use):
                        vec = self.emb[ids[pos]].mean(1)
                        grad["taps"][tap + j][:, use] += (vec * d[f][use, None]).T
                        step = self.taps[tap + j][:, use].T * d[f][use, None] / ids.shape[1]
                        np.add.at(grad["emb"], ids[pos].ravel(), np.repeat(step, ids.shape[1], 0))
                tap += width
        return grad

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in ("emb", "taps", "bias", "out")}
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                # words left out at random, so that no single word of a document is learnt by heart
                seen = [ids[rng.random(len(ids)) < KEEP] if len(ids) > 4 else ids for ids in (texts[i] for i in batch)]
                grad = self.gradients(seen, labels[batch], weight[batch])
                for n, (m, v) in state.items():
                    x, g = getattr(self, n), grad[n]
                    rows = np.flatnonzero(g.any(1)) if n == "emb" else slice(None)  # embeddings not met don't move
                    m[rows] = 0.9 * m[rows] + 0.1 * g[rows]
                    v[rows] = 0.99 * v[rows] + 0.01 * g[rows] ** 2
                    x[rows] -= RATE * m[rows] / (np.sqrt(v[rows]) + 1e-6)

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return np.maximum(raw, 0) @ self.out[:-1] + self.out[-1] + self.prior


class Scorer:
    """Scores texts fast: every distinct word is projected on all filter taps once, and many texts are pooled at once."""

    def __init__(self, model: Convolution):
        self.m = model
        self.flat = np.concatenate(list(model.taps), 1).astype(np.float32)  # (SIZE, taps * FILTERS)
        self.emb = model.emb.astype(np.float32)
        self.rows = [np.zeros((KEPT_WORDS, FILTERS), np.float32) for _ in model.taps]  # by tap; row 0 is no word
        self.at: dict[str, int] = {}
        self.taken = [np.zeros((0, FILTERS), np.float32)] * 2

    def places(self, words: list[str]) -> list[int]:
        found = list(map(self.at.get, words))
        if None in found:
            new = list({w for w, f in zip(words, found) if f is None})
            if len(self.at) + len(new) >= KEPT_WORDS:
                self.at.clear()
                new = list(set(words))
            start = len(self.at) + 1
            response = self.emb[np.array([word_ids(w) for w in new])].mean(1) @ self.flat
            for k, table in enumerate(self.rows):
                table[start : start + len(new)] = response[:, k * FILTERS : (k + 1) * FILTERS]
            self.at.update(zip(new, range(start, start + len(new))))
            found = list(map(self.at.get, words))
        return found

    def pooled(self, texts: list[list[str]]) -> np.ndarray:
        """As Convolution.pooled for each text; long texts in chunks that overlap by the widest filter."""
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        over, pieces, held = max(WIDTHS) - 1, [], 0
        for i, words in enumerate(texts):
            for k in range(0, max(1, len(words) - over), CHUNK):
                pieces.append((i, words[k : k + CHUNK + over]))
                held += len(pieces[-1][1])
                if held >= CHUNK:
                    self.pool(pieces, best)
                    pieces, held = [], 0
        self.pool(pieces, best)
        return best + self.m.bias

    def pool(self, pieces: list[tuple[int, list[str]]], best: np.ndarray) -> None:
        gap = [""] * max(WIDTHS)  # no filter reaches from one piece into the next
        self.at.setdefault("", 0)
        flat = np.array(self.places([w for _, p in pieces for w in (*p, *gap)]), np.intp)
        if len(flat) > len(self.taken[0]):
            self.taken = [np.empty((len(flat), FILTERS), np.float32) for _ in range(2)]
        tap = 0
        for w, width in enumerate(WIDTHS):
            n = len(flat) - width + 1
            conv, more = (x[: max(n, 0)] for x in self.taken)
            for j in range(width if n > 0 else 0):
                np.take(self.rows[tap + j], flat[j : j + n], axis=0, out=more if j else conv, mode="clip")
                if j:
                    conv += more
            f, start = slice(w * FILTERS, (w + 1) * FILTERS), 0
            for i, p in pieces:
                part, size = conv[start:], max(1, len(p) - width + 1)  # a short text ends in words that are none
                while size > 1:
                    half = size // 2
                    np.maximum(part[:half], part[size - half : size], out=part[:half])
                    size -= half
                best[i, f] = np.maximum(best[i, f], part[0])
                start += len(p) + len(gap)
            tap += width

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = self.pooled([text_words(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.m.logit(raw), -40, 40)))


def known_labels(docs: DataFrame, labels: DataFrame, target: str, usable: Column) -> DataFrame:
    """doc_id, y: one row for each labelled document that is there.

    Rows with null ids, labels other than 0 or 1, and ids with both labels don't count.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y2")).where("y = y2").drop("y2")
    return known.join(docs.select("doc_id"), "doc_id", "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, most: dict[int, int], metadata: tuple[str, ...] = ()):
    """(rows of doc_id, y, text, more on the driver, counts by label): at most ``most`` of each class, by hash order.

    Of repeated ids the smallest text counts; ``more`` holds the values of ``metadata`` columns as text.
    """
    known = written(known_labels(docs, labels, target, usable), "labels-known")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = None
    for y, n in most.items():
        some = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    more = F.array(*(F.col(f"`{c}`").cast("string") for c in metadata)).cast("array<string>").alias("more")
    texts = docs.select("doc_id", "text", more).join(F.broadcast(picked), "doc_id")  # bounded by ``most``
    rows = texts.groupBy("doc_id", "y").agg(F.min(F.struct("text", "more")).alias("t")).select("doc_id", "y", "t.text", "t.more").collect()
    return sorted(rows, key=lambda r: r.doc_id), counts


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: dict[int, int] | None = None) -> Convolution:
    """Fits on nine tenths of the sample; without both classes every score is 0.5 or the one class's.

    ``fitted`` holds the ids that the fit read (bounded by the sample), which the thresholds leave out.
    """
    rows, counts = labelled_sample(docs, labels, "toxic", usable, most or SAMPLE)
    model = Convolution.new()
    y = np.array([r.y for r in rows], np.int64)
    if len(set(y)) < 2:
        model.out[:] = 0
        model.prior = 0.0 if not len(y) else (30.0 if y[0] else -30.0)
        return model
    fitted = np.array([crc32(f"fit:{r.doc_id}".encode()) % 10 != 0 for r in rows])
    ids = [np.array([word_ids(w) for w in text_words(r.text)], np.int32).reshape(-1, 1 + len(PREFIXES)) for r, f in zip(rows, fitted) if f]
    model.fit(ids, y[fitted])
    model.prior = float(np.log(counts[1] / counts[0]))  # the fit weighs both classes alike
    model.fitted = [r.doc_id for r, f in zip(rows, fitted) if f]
    return model


def threshold(right: np.ndarray, wrong: np.ndarray) -> float:
    """From weights of toxic and other documents by score bin: the least bin from which up the precision reaches ``PRECISION``, halfway to the next one below that holds any; else 0.5."""
    top = np.arange(len(right))[::-1]
    a, b = np.cumsum(right[top]), np.cumsum(wrong[top])
    ok = np.flatnonzero((a + b > 0) & (a >= PRECISION * (a + b)))
    if not len(ok) or not a[-1]:
        return 0.5
    filled = np.flatnonzero(right + wrong)
    at = filled[filled >= top[ok[-1]]].min()
    low = filled[filled < at].max(initial=0)
    return float(min(0.9, max(0.3, (at + low + 1) / 2 / len(right))))


def calibrated(scores: DataFrame, docs: DataFrame, labels: DataFrame, usable: Column, model: Convolution) -> tuple[dict[str, float], float]:
    """(thresholds by language, the threshold of all others) from every labelled document that the fit did not read.

    ``scores`` has doc_id, lang, score.  Histograms by language are pre-aggregated; of repeated ids every row counts.
    """
    spark = scores.sparkSession
    known = known_labels(docs, labels, "toxic", usable)
    read = spark.createDataFrame([(i,) for i in model.fitted], f"doc_id {dict(scores.dtypes)['doc_id']}")
    rest = known.join(F.broadcast(read), "doc_id", "left_anti")  # bounded by the sample
    bins = F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int").alias("bin")
    counts = scores.select("doc_id", "lang", bins).join(rest, "doc_id").groupBy("lang", "bin", "y").agg(F.count("*").alias("n"))
    whole = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    found = counts.collect()  # languages are few
    left = {y: max(1, sum(r.n for r in found if r.y == y)) for y in (0, 1)}
    of: dict[str | None, np.ndarray] = {}
    for r in found:
        of.setdefault(r.lang, np.zeros((2, SCORE_BINS)))[r.y, r.bin] += r.n
    if not of:
        return {}, 0.5
    scale = np.array([[whole.get(y, 0) / left[y]] for y in (0, 1)])  # the fit took more of one class than of the other
    own = {lang: threshold(*(h * scale)[::-1]) for lang, h in of.items() if lang is not None and h[1].sum() >= LEAST_TOXIC}
    return own, threshold(*(sum(of.values()) * scale)[::-1])


def scored(docs: DataFrame, model: Convolution, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of all columns, or of those to ``keep``), doc_id, lang (null where there is none), score: one for each of ``docs``.

    Whole texts are scored, very long ones in chunks; null and empty ones have the score of no words; repeated rows come back
    as often; columns of any name are safe inside the struct; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    cols = docs.select(packed_row(docs, keep), "doc_id", lang.alias("lang"), *text_column(docs, keep))

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            texts = texts_of(b)
            score = np.concatenate([scorer.scores(texts.slice(k, 256).to_pylist()) for k in range(0, b.num_rows, 256)] or [np.zeros(0)])
            yield {c: b.column(c) for c in ("row", "doc_id", "lang")} | {"score": score}

    return mapped(cols, run, T.StructType([*(cols.schema[c] for c in ("row", "doc_id", "lang")), T.StructField("score", T.DoubleType())]))


def classified(docs: DataFrame, labels: DataFrame, usable: Column, keep: tuple[str, ...] | None = None) -> DataFrame:
    """As scored(), with threshold (its language's) and toxic (score at or above it): trains, scores once, calibrates on the scores."""
    model = train(docs, labels, usable)
    rows = written(scored(docs, model, keep), "toxicity-scores")
    own, default = calibrated(rows, docs, labels, usable, model) if model.fitted else ({}, 0.5)
    limit = F.lit(default)
    if own:
        pairs = [x for lang, t in sorted(own.items()) for x in (F.lit(lang), F.lit(t))]
        limit = F.coalesce(F.element_at(F.create_map(*pairs), F.col("lang")), limit)
    return rows.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, toxic for every row of ``docs``; labels of held-out documents (crc32(doc_id) mod 5 = 0) are never learnt.

    Null and empty texts have the score of no words; a null doc_id is not held out and has no label; repeated rows and ids
    come back as often; an empty table gives no rows; no labels give the score 0.5; other columns are ignored.
    """
    out = classified(docs, labels, crc_of_id() % 5 != 0, ("doc_id",))
    return out.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose toxicity score is below their language's threshold, with all their columns.

    Every label is used.  Null and empty texts have the score of no words; repeated rows share their fate; rows with null ids
    are scored like others; columns may have any names; an empty table gives no rows.
    """
    return classified(docs, labels, F.lit(True)).where(~F.col("toxic")).select("row.*")
