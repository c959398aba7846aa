"""Quality classifier: random-indexing word vectors, pooled, then a small network.

Every token gets a fixed sparse random index vector; its word vector is the sum of the
index vectors of its neighbours over the whole corpus.  A document is the mean of its word
vectors, over all tokens and over distinct ones, with a few figures on the pooling itself.
A network of two layers, written in numpy, scores it, and a temperature fitted on rows kept
out of its training calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import labelled_sample, summed, text_chunks, with_outputs
from .tokens import LETTER, Segment, segments

#: Word vectors by hashed token, in four equal parts for the shapes of a token.
BUCKETS = 1 << 14
DIM = 48
WINDOW = 2
NONZEROS = 2
#: Labelled documents that the network is fitted on, at most.
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 25
SEED = 5
WIDTH = 2 * DIM + 6

_PART = BUCKETS // 4
_UPPER = np.array([65 <= b <= 90 for b in range(256)], np.uint8)
_LOWER = np.array([97 <= b <= 122 for b in range(256)], np.uint8)


def buckets(own: Segment) -> np.ndarray:
    """Bucket of every token: a quarter by its shape (lower case, capitals, capitalised,
    not a word), a place in it by its hash."""
    if not len(own.doc):
        return np.zeros(0, np.int64)
    zero = np.zeros(1, np.int64)
    upper = np.concatenate([zero, np.cumsum(_UPPER[own.data], dtype=np.int64)])
    lower = np.concatenate([zero, np.cumsum(_LOWER[own.data], dtype=np.int64)])
    up, low = upper[own.end] - upper[own.start], lower[own.end] - lower[own.start]
    shape = np.where(own.kind != LETTER, 3, np.where((up > 1) & (low == 0), 1, np.where(up > 0, 2, 0)))
    return shape * _PART + (own.hashes(own.start, own.end) % np.uint64(_PART)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZEROS)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZEROS))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (buckets x dim) from the contexts in every document's whole text."""

    def count(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIM, np.float64)
        for batch in text_chunks(batches):
            tail, tail_doc = np.zeros(0, np.int64), -1  # the end of a text that goes on in the next segment
            for own in segments(batch.column("text").to_pylist()):
                words, doc, old = buckets(own), own.doc, 0
                if len(doc) and doc[0] == tail_doc:
                    words, doc, old = np.concatenate([tail, words]), np.concatenate([np.full(len(tail), tail_doc), doc]), len(tail)
                for gap in range(1, WINDOW + 1):
                    first = max(0, old - gap)  # pairs inside the tail are counted already
                    same = doc[first + gap :] == doc[first : len(doc) - gap]
                    a, b = words[first : len(doc) - gap][same], words[first + gap :][same]
                    for word, near in ((a, b), (b, a)):
                        at = (word[:, None] * DIM + place[near]).ravel()
                        total += np.bincount(at, weights=sign[near].ravel(), minlength=BUCKETS * DIM)
                if len(doc):
                    tail_doc = doc[-1]
                    tail = words[-WINDOW:][doc[-WINDOW:] == tail_doc]
        return {"contexts": total.astype(np.int64)}

    found = summed(docs.where("text is not null").select("text"), count, BUCKETS * DIM // 64)
    table = np.zeros(BUCKETS * DIM)
    if "contexts" in found:
        table[: len(found["contexts"])] = found["contexts"]
    table = table.reshape(BUCKETS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """The features of each text; all zero for one without tokens."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    keys, counts = [], []
    for own in segments(texts):
        k, n = np.unique(own.doc * BUCKETS + buckets(own), return_counts=True)
        keys.append(k), counts.append(n)
    key, n = (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64),) * 2
    if len(keys) > 1:  # a long text has tokens in several segments
        key, of = np.unique(key, return_inverse=True)
        n = np.bincount(of, weights=n).astype(np.int64)
    if not len(key):
        return out
    doc, at = key // BUCKETS, key % BUCKETS
    first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    row, own = doc[first], vectors[at]
    total, distinct = np.add.reduceat(n, first), np.diff([*first, len(doc)])
    out[row, :DIM] = np.add.reduceat(own * n[:, None].astype(np.float32), first) / total[:, None]
    out[row, DIM : 2 * DIM] = np.add.reduceat(own, first) / distinct[:, None]
    out[row, 2 * DIM] = np.log1p(total) / 10
    out[row, 2 * DIM + 1] = np.log((distinct + 1) / (total + 1))
    out[row, 2 * DIM + 2] = np.maximum.reduceat(n, first) / total
    for shape in (1, 2, 3):
        out[row, 2 * DIM + 2 + shape] = np.add.reduceat(n * (at // _PART == shape), first) / total
    return out


@dataclass
class Network:
    """Two layers and a temperature; ``score`` is the calibrated probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_sigmoid(z), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Fit with Adam, then the temperature on every fifth row, which training leaves out.

    Without rows, or with one label only, the score is constant: the share of label 1 (a
    half without rows).
    """
    width = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(width)
    if len(np.unique(y)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Network(mean, scale, np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, own = (order[::5], np.delete(order, np.s_[::5])) if len(x) >= 50 else (order, order)
    z = ((x - mean) / scale).astype(np.float32)
    params = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    params = [p.astype(np.float32) for p in params]
    m, v, t = [0 * p for p in params], [0 * p for p in params], 0
    epochs = max(EPOCHS, 4000 // max(1, len(own) // 64 + 1) if len(own) < 4000 else EPOCHS)
    for epoch in range(min(epochs, 400)):
        own = rng.permutation(own)
        rate = 3e-3 * (1 - epoch / min(epochs, 400)) + 1e-4
        for at in range(0, len(own), 64):
            i = own[at : at + 64]
            hidden = np.maximum(z[i] @ params[0] + params[1], 0)
            error = (_sigmoid(hidden @ params[2] + params[3]) - y[i]) / len(i)
            back = np.outer(error, params[2]) * (hidden > 0)
            grads = [z[i].T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], error.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    raw = net.logit(x[aside])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    net.temperature = float(min(grid, key=lambda g: _loss(raw / g, y[aside])))
    return net


def features(rows: DataFrame, vectors: np.ndarray, keep: str) -> DataFrame:
    """``keep`` and the document features as a float32 blob."""
    sent = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            blobs = [x.astype("<f4").tobytes() for x in pooled(batch.column("text").to_pylist(), sent.value)]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(blobs, pa.binary())], names=[keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {dict(rows.dtypes)[keep]}, x binary")


def fit(docs: DataFrame, labels: DataFrame, keep, bound: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all ``docs``, and a network from at most ``bound`` labelled ones."""
    vectors = word_vectors(docs)
    got = features(labelled_sample(docs, labels, "quality", keep, bound), vectors, "y").toArrow()
    # At most ``bound`` rows: sorted here, so that training sees them in one order.
    rows = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist()))
    x = np.frombuffer(b"".join(x for x, _ in rows), "<f4").reshape(-1, WIDTH)
    return vectors, train(x, np.array([y for _, y in rows], np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, *keep: str) -> DataFrame:
    """``keep`` columns and, last, ``score`` (``score_`` where a kept column has that name).

    Null and empty texts get the score of no tokens; a long text is read in segments, whole;
    repeated rows and null ids keep their rows; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def work(texts: list[str | None]) -> list[pa.Array]:
        own, model = sent.value
        return [pa.array(model.score(pooled(texts, own)).astype(np.float64))]

    return with_outputs(docs, keep, {"score": "double"}, work)
