"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Labellers overlap: every kind of junk is seen by several. Each votes junk or
nothing, one votes clean or nothing. The counts of the vote patterns of all
documents (at most 2 ** labellers rows) reach the driver, where EM estimates
how often each labeller's votes are right and the probability of junk under
each pattern. These posteriors label a bounded sample, on which a
linear scorer over hashed shapes of the text is fitted; it scores every
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import DIGITS, SPACED, byte_set, chunks, row_of, span_hashes, word_spans
from .common import bounded

#: Documents that fit the scorer; hashed features; a document is rejected from this score on.
SAMPLE, FEATURES, REJECT = 3000, 1024, 0.5
_LETTER, _UPPER = byte_set((65, 90), (97, 122), (128, 255)), byte_set((65, 90))
_MARK = byte_set((33, 33), (35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 126))
#: Labellers of junk: name, measure, ordinary up to, junk from. One more labeller votes clean where all measures are ordinary.
LABELLERS = [("marks", 0, 0.02, 0.05), ("capitals", 1, 0.3, 0.5), ("echoes", 2, 0.05, 0.2), ("bars", 3, 0.01, 0.08), ("marked words", 4, 0.05, 0.15), ("variety", 5, 0.55, 0.8)]
#: Words under which a document is too short for labellers that count words.
FEW = 8


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, 6]: shares of mark bytes, of capitals among letters, of words equal to the one before, of words of one bar, of words that end in a mark, and of repeated words among the first hundred of each hundred. NaN: too short to tell."""
    n = len(offsets) - 1

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = np.full((n, 6), np.nan)
    length, letters = np.diff(offsets), share(_LETTER)
    with np.errstate(invalid="ignore", divide="ignore"):
        out[:, 0] = np.where(length >= 4 * FEW, share(_MARK) / length, np.nan)
        out[:, 1] = np.where(letters >= 4 * FEW, share(_UPPER) / letters, np.nan)
        starts, ends = word_spans(data, offsets, SPACED)
        rows = row_of(starts, offsets)
        words = np.bincount(rows, minlength=n)
        enough = words >= FEW
        hashes = span_hashes(data, starts, ends, DIGITS)
        echo = np.zeros(len(rows))
        echo[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        bar = (ends - starts == 1) & (data[starts] == 124) if len(starts) else np.zeros(0)
        marked = _MARK[data[ends - 1]] & (ends - starts > 1) if len(starts) else np.zeros(0)
        for i, x in ((2, echo), (3, bar), (4, marked)):
            out[:, i] = np.where(enough, np.bincount(rows, weights=np.asarray(x, float), minlength=n) / words, np.nan)
        first = np.searchsorted(rows, np.arange(n))
        block = rows * (1 << 32) + (np.arange(len(rows)) - first[rows]) // 100
        order = np.lexsort((hashes, block))
        again = np.zeros(len(rows))
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (block[order][1:] == block[order][:-1])
        out[:, 5] = np.where(words >= 5 * FEW, np.bincount(rows[order], weights=again, minlength=n) / words, np.nan)
    return out


def votes(found: np.ndarray) -> np.ndarray:
    """The votes on each row as bits: those of the labellers of junk in order, then that of the labeller of clean."""
    code, plain = np.zeros(len(found), np.int64), np.ones(len(found), bool)
    for i, (_, column, ordinary, junk) in enumerate(LABELLERS):
        x = found[:, column]
        with np.errstate(invalid="ignore"):
            code |= (x >= junk).astype(np.int64) << i
            plain &= x <= ordinary
    return code | plain.astype(np.int64) << len(LABELLERS)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of junk for each pattern, accuracy of each labeller, share of junk) by EM.

    A vote is right with its labeller's accuracy; not voting tells nothing.
    Accuracies start at 0.9 and are held there by the weight of 20 votes.
    """
    m = len(LABELLERS) + 1
    cast = np.stack([(codes >> i) & 1 for i in range(m)]).astype(float)
    side = np.array([1.0] * (m - 1) + [-1.0])
    accuracy, share, total = np.full(m, 0.9), 0.1, max(1.0, counts.sum())
    post = np.zeros(len(codes))
    for _ in range(rounds):
        weight = side * np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + weight @ cast)))
        share = float(np.clip((post * counts).sum() / total, 0.02, 0.5))
        right = np.where(side[:, None] > 0, post, 1 - post)
        accuracy = np.clip(((cast * right * counts).sum(axis=1) + 18) / ((cast * counts).sum(axis=1) + 20), 0.6, 0.995)
    return post, accuracy, share


_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[byte_set((97, 122), (128, 255))] = 97
_SHAPE[byte_set((65, 90))] = 65
_SHAPE[byte_set((48, 57))] = 48
_SHAPE[byte_set((9, 13), (32, 32))] = 32


def features(data: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """float32 [rows, FEATURES]: roots of the shares of hashed shape trigrams, and hashed steps of the measures."""
    n = len(offsets) - 1
    shape = _SHAPE[data]
    out = np.zeros((n, FEATURES), np.float32)
    if len(shape) > 2:
        code = (((shape[:-2] << np.uint64(16)) | (shape[1:-1] << np.uint64(8)) | shape[2:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
        rows = np.repeat(np.arange(n), np.diff(offsets))[:-2]
        inside = np.arange(len(code)) + 3 <= offsets[1:][rows]
        counts = np.bincount(rows[inside] * FEATURES + code[inside].astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES)
        out = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)
    for column in range(found.shape[1]):
        step = np.where(np.isnan(found[:, column]), 11, np.clip(np.nan_to_num(found[:, column]) * 10, 0, 10)).astype(int)
        place = ((np.arange(12) + 100 * (column + 1)) * 2654435761 >> 7) % FEATURES
        out[np.arange(n), place[step]] += 1.0
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam, full batches."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / max(1, len(y)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(votes(measures(data, offsets)))], names=["doc_id", "pattern"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(1)):
            found = measures(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(votes(found)), pa.array([x.tobytes() for x in features(data, offsets, found)], pa.binary())], names=["pattern", "x"])


class Model:
    """Posterior of each vote pattern, and the scorer; of bounded size, sent to tasks as it is."""

    def __init__(self, posteriors: dict[int, float], weights: np.ndarray, bias: float):
        self.posteriors, self.weights, self.bias = posteriors, weights, bias

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(vote patterns, probabilities of junk) of texts."""
        patterns, scores = [], []
        for _, _, data, offsets in chunks(column):
            found = measures(data, offsets)
            patterns.append(votes(found))
            scores.append(1 / (1 + np.exp(-np.clip(features(data, offsets, found) @ self.weights + self.bias, -30, 30))))
        return np.concatenate(patterns or [np.zeros(0, np.int64)]), np.concatenate(scores or [np.zeros(0)])


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over the vote patterns of all documents; the scorer on at most ``sample`` of them, drawn by a hash of the text."""
    bounded(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = docs.mapInArrow(_vote, "doc_id long, pattern long").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    codes, counts = np.array([r.pattern for r in seen], np.int64), np.array([r.n for r in seen], float)
    post, _, _ = estimate(codes, counts)
    posteriors = dict(zip(codes.tolist(), post.tolist()))
    total = int(counts.sum())
    if not total:
        return Model({}, np.zeros(FEATURES), -10.0)
    # A draw of about the wanted size by hash, then exactly the first by hash: the driver gets no more than ``sample`` rows.
    drawn = F.xxhash64("text", "doc_id")
    limit = int(-(1 << 63) + min(1.0, 1.5 * sample / total) * ((1 << 64) - 1))
    chosen = docs.where(drawn <= F.lit(min(limit, (1 << 63) - 1))).orderBy(drawn, "doc_id").limit(sample)
    rows = chosen.mapInArrow(_features, "pattern long, x binary").collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    weights, bias = fit(x, np.array([posteriors[r.pattern] for r in rows]))
    return Model(posteriors, weights, bias)


_OUT = "doc_id long, pattern long, posterior double, score double, kept boolean"


def judge(documents: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, pattern, posterior, score, kept of every whole text.

    score is the scorer's probability of junk, kept whether it is under
    ``reject``; posterior is what the labellers alone say. Null texts count as
    empty. Labellers do not vote on texts too short for them. Rows are
    independent given the model; other columns are not read. Of an empty table
    nothing is learnt and there are no rows.
    """
    model = train(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, scores = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns), pa.array([model.posteriors.get(p, 0.0) for p in patterns.tolist()], pa.float64()), pa.array(scores.astype(np.float64)), pa.array(scores < reject)], names=[x.split()[0] for x in _OUT.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def keep_good(documents: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents under ``reject``, with all their columns."""
    model, place = train(documents), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(place).cast(pa.string()))[1] < reject))

    return documents.mapInArrow(run, documents.schema)
