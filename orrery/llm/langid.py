"""Language identification by mixture inference.

Every language is a distribution over hashed byte n-grams of its lower-cased text.  For a
document, expectation-maximisation estimates the share of each language from the n-gram
likelihoods; the set of languages is then the one whose likelihood, less a penalty for each
further language, is highest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import summed, text_chunks, with_outputs

GRAM = 3
#: A long text is worked on in pieces of about so many characters.
PIECE_CHARS = 1_000_000
BUCKETS = 1 << 16
SMOOTHING = 0.1
EM_STEPS = 12
#: Overlapping n-grams repeat each other: each counts as this part of an observation.
GRAM_WEIGHT = 1.0 / GRAM
#: Further languages cost this many times half the logarithm of the observations each.
PENALTY = 6.0
UNKNOWN = "und"

_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _letters(text: str) -> bytes:
    """The lower-cased bytes of the words, with one space between."""
    return b" ".join(text.lower().encode().translate(_SPACE).split())


def grams(text: str, before: bytes = b"") -> np.ndarray:
    """Bucket of every n-gram of the words' bytes, one space around; ``before`` is the last byte
    of the words that go before, if any."""
    data = before + b" " + _letters(text) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < GRAM + len(before):
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(16)).astype(np.int64)


def counted(text: str) -> np.ndarray:
    """How often every bucket's n-grams are in a whole text; a long one is read in pieces that
    end at a space."""
    if len(text) <= PIECE_CHARS:
        return np.bincount(grams(text), minlength=BUCKETS)
    total, at, before = np.zeros(BUCKETS, np.int64), 0, b""
    while at < len(text):
        end = text.find(" ", at + PIECE_CHARS)
        end = len(text) if end < 0 else end
        total += np.bincount(grams(text[at:end], before), minlength=BUCKETS)
        before = _letters(text[max(at, end - 64) : end])[-1:] or _letters(text[at:end])[-1:] or before
        at = end
    return total


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-likelihoods (buckets x languages), from all given rows.

    Rows with a null text or language are left out.  No rows at all give no languages, and
    every prediction is then ``und``.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray]:
        tables: dict[str, np.ndarray] = {}
        for batch in text_chunks(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if len(text) > PIECE_CHARS:
                    table += counted(text)
                else:
                    by_lang.setdefault(lang, []).append(grams(text))
            for lang, found in by_lang.items():
                tables[lang] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        return tables

    tables = summed(docs.where("text is not null and lang is not null").select("lang", "text"), count, BUCKETS // 16)
    langs = sorted(tables)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([np.pad(tables[k], (0, BUCKETS - len(tables[k]))) for k in langs], axis=1) + SMOOTHING
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Mixture shares and log-likelihood for row-scaled likelihoods and their counts."""
    share = start
    for _ in range(steps):
        mixed = like @ share
        share = share * ((n / mixed) @ like) / n.sum()
    return share, float(n @ np.log(like @ share))


def infer(text: str | None, model: np.ndarray) -> np.ndarray | None:
    """Shares of the languages in one text; None if it is null or has no letter."""
    if not text or not model.shape[1] or not any(map(str.isalpha, text)):
        return None
    found = counted(text)
    at = np.flatnonzero(found)
    if not len(at):
        return None
    n = found[at] * GRAM_WEIGHT
    rows = model[at]
    alone = n @ rows
    best = int(np.argmax(alone))
    cost = PENALTY * 0.5 * np.log(n.sum() + 1.0)
    # The likelihood is concave: from one language alone it can rise by no more than this.
    rise = n @ np.exp(rows - rows[:, best : best + 1]) - n.sum()
    k = model.shape[1]
    one = np.zeros(k)
    one[best] = 1.0
    if rise.max() <= cost:
        return one
    top = rows.max(axis=1, keepdims=True)
    like = np.exp(rows - top)
    base = float(n @ top[:, 0])
    share, full = _em(like, n, np.full(k, 1.0 / k), EM_STEPS)
    if base + full - cost <= alone[best]:
        return one
    # Nested sets in the order of the shares, each fitted afresh.
    order = np.argsort(-share, kind="stable")
    chosen, score = one, float(alone[best])
    for size in range(2, k + 1):
        own = np.sort(order[:size])
        part, fit_ = _em(like[:, own], n, np.full(size, 1.0 / size), EM_STEPS)
        if base + fit_ - cost * (size - 1) <= score:
            break
        score = base + fit_ - cost * (size - 1)
        chosen = np.zeros(k)
        chosen[own] = part
    return chosen


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (its share) and ``lang_shares`` of whole texts.

    A null text, or one without a letter, is ``und`` with score 0.  Ties go to the language
    that sorts first.  A long text is counted in pieces, whole; repeated rows keep their rows;
    an empty table gives an empty one; an output whose name a kept column has gets an
    underscore.  What is broadcast is a table of buckets x languages (256 KB a language).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[pa.Array]:
        preds, scores, sets = [], [], []
        for text in texts:
            share = infer(text, sent.value)
            if share is None:
                preds.append(UNKNOWN), scores.append(0.0), sets.append([])
            else:
                share = share / share.sum()
                top = int(np.argmax(share))
                preds.append(langs[top]), scores.append(min(1.0, float(share[top])))
                sets.append([{"lang": langs[i], "share": float(share[i])} for i in np.flatnonzero(share > 0)])
        return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]

    return with_outputs(docs, keep, {"lang_pred": "string", "score": "double", "lang_shares": "array<struct<lang: string, share: double>>"}, work)
