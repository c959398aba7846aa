"""Toxicity classifier with a counterfactual penalty.

A logistic model over the words of a text and the stems of longer words.  In every sentence of
a labelled text, identity terms are swapped for others of the same language group (a term is
put into one sentence of a text that has none), and the model pays for every change of a
sentence's score by the swap.  So a group mention by itself carries no weight, and neutral
mentions are not taken for abuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import labelled_sample, summed, text_chunks, with_outputs
from .tokens import LETTER, segments

BUCKETS = 1 << 18
#: Word features kept, by the strength of their link with the label, besides identity terms.
KEPT = 2048
#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
RIDGE = 2e-4
SWAP_PENALTY = 1.0
STEPS = 400
#: A feature must be in this many labelled texts of the sample ...
LEAST_TEXTS = 3
#: ... and its link with the label be this many standard errors strong.
LEAST_LINK = 4.75
#: Besides itself, a word gives these first bytes of it, if it goes on: roots of compounds.
STEMS = (5, 6, 7)

# Identity terms whose swap must not change a score.
IDENTITY = {
    "en": ["women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gays", "lesbians", "asians", "africans", "europeans", "mexicans", "elderly", "disabled"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "homosexuels", "africains", "asiatiques"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwule", "lesben", "afrikaner"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "homosexuales", "africanos", "asiáticos"],
}
# Other forms of the terms: they are the same feature.
FORMS = {
    "women": "woman", "men": "man", "muslims": "muslim", "christians": "christian", "jews": "jew", "hindus": "hindu", "immigrants": "immigrant", "refugees": "refugee", "gays": "gay",
    "lesbians": "lesbian", "asians": "asian", "africans": "african", "europeans": "european", "mexicans": "mexican",
    "femmes": "femme", "hommes": "homme", "musulmans": "musulman musulmanes musulmane", "chrétiens": "chrétien chrétiennes chrétienne", "juifs": "juif juives juive", "immigrés": "immigré immigrées immigrée",
    "réfugiés": "réfugié réfugiées réfugiée", "homosexuels": "homosexuel homosexuelles homosexuelle", "africains": "africain africaines africaine", "asiatiques": "asiatique",
    "frauen": "frau", "männer": "mann männern", "muslime": "muslimen muslimin muslima musliminnen", "christen": "christ christin christinnen", "juden": "jude jüdin jüdinnen", "einwanderer": "einwanderern einwanderin einwanderinnen",
    "flüchtlinge": "flüchtling flüchtlingen", "schwule": "schwuler schwulen", "lesben": "lesbe", "afrikaner": "afrikanern afrikanerin afrikanerinnen",
    "mujeres": "mujer", "hombres": "hombre", "musulmanes": "musulmán musulmana musulmanas", "cristianos": "cristiano cristiana cristianas", "judíos": "judío judía judías", "inmigrantes": "inmigrante",
    "refugiados": "refugiado refugiada refugiadas", "homosexuales": "homosexual", "africanos": "africano africana africanas", "asiáticos": "asiático asiática asiáticas",
}
_GROUP = {term: lang for lang, terms in IDENTITY.items() for term in terms}
_TERMS = list(_GROUP)
# Each written form once; a form that is itself a term, or that two terms share, is the first one's.
_FORM_OF = {form: i for i, term in reversed([*enumerate(_TERMS)]) for form in FORMS.get(term, "").split()} | {term: i for i, term in enumerate(_TERMS)}
_SENTENCE = re.compile("(?<=[.!?\u2026\u3002])\\s+|\n+")
_SPACES = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")


def _normal(text: str | None) -> str:
    """Lower case, with the marks beyond ASCII that may touch a word as spaces."""
    text = (text or "").lower()
    return text if text.isascii() else _SPACES.sub(" ", text)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


class _Listed:
    """Hashes that are looked up among many others: a bucket's mark first, then the hash."""

    def __init__(self, hashes: np.ndarray, value: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.value = hashes[order], value[order]
        self.likely = np.zeros(BUCKETS, bool)
        self.likely[_bucket(hashes)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of listed hashes, and their values."""
        near = np.flatnonzero(self.likely[_bucket(hashes)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[near]
        return near[hit], self.value[place[hit]]


def _term_hashes() -> _Listed:
    own = next(segments([" ".join(_FORM_OF)]))
    return _Listed(own.hashes(own.start, own.end), np.array(list(_FORM_OF.values())))


def _stem_hashes(n: int) -> _Listed:
    """The first ``n`` bytes of every form that is as long."""
    own = next(segments([" ".join(_FORM_OF)]))
    start = own.start[own.end - own.start >= n]
    hashes = np.unique(own.hashes(start, start + n, salt=n))
    return _Listed(hashes, np.zeros(len(hashes), np.int64))


SIZE = BUCKETS + len(_TERMS)


def features(texts: list[str | None], allowed: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct features of each text, in order; identity terms come after the words.

    A feature is a word, or a stem of a longer word; with ``allowed`` only those marked.
    A stem that an identity term has too is none, in whatever word: it would carry the
    weight of the term past the swap.
    """
    terms, roots = _term_hashes(), {n: _stem_hashes(n) for n in STEMS}
    keys = []
    for own in segments([_normal(t) for t in texts]):
        own = own.where(own.kind == LETTER)
        h = own.hashes(own.start, own.end)
        word = _bucket(h)
        hit, term = terms.find(h)
        word[hit] = BUCKETS + term
        found = [(own.doc, word)]
        for n in STEMS:
            longer = own.end - own.start > n
            longer[hit] = False
            start = own.start[longer]
            stem = own.hashes(start, start + n, salt=n)
            free = np.ones(len(stem), bool)
            free[roots[n].find(stem)[0]] = False
            found.append((own.doc[longer][free], _bucket(stem[free])))
        for doc, at in found:
            if allowed is not None:
                keep = allowed[at]
                doc, at = doc[keep], at[keep]
            keys.append(doc * SIZE + at)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return [k % SIZE for k in np.split(key, np.searchsorted(key, np.arange(1, len(texts)) * SIZE))] if texts else []


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: they end at a full stop, question or exclamation mark before
    white space, or at a line break."""
    return [s for s in _SENTENCE.split(text or "") if s]


def mentions(texts: list[str | None]) -> list[list[tuple[int, ...]]]:
    """For each text the identity terms of every sentence that has any; the empty tuple, once,
    for a text without one.  Terms are numbers of ``IDENTITY`` in order."""
    terms = _term_hashes()
    out: list[list[tuple[int, ...]]] = [[] for _ in texts]
    parts, of = [], []
    for i, text in enumerate(texts):
        own = sentences(_normal(text))
        parts += own
        of += [i] * len(own)
    found: dict[int, set[int]] = {}
    for own in segments(parts):
        own = own.where(own.kind == LETTER)
        hit, term = terms.find(own.hashes(own.start, own.end))
        for s, t in zip(own.doc[hit], term):
            found.setdefault(int(s), set()).add(int(t))
    for s in sorted(found):
        out[of[s]].append(tuple(sorted(found[s])))
    return [x or [()] for x in out]


def swapped(terms: tuple[int, ...], turn: int) -> tuple[int, ...]:
    """The terms of a sentence's counterfactual: every identity term becomes another of its
    group, and a sentence without one gets one."""
    if not terms:
        return (turn % len(_TERMS),)
    new = set()
    for f in terms:
        group = IDENTITY[_GROUP[_TERMS[f]]]
        at = (group.index(_TERMS[f]) + 1 + turn % (len(group) - 1)) % len(group)
        new.add(_TERMS.index(group[at]))
    return tuple(sorted(new))


@dataclass
class Model:
    """Weights by feature; features that were not kept weigh nothing."""

    weight: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = self.bias + float(self.weight[features].sum())
        return 1 / (1 + float(np.exp(-np.clip(z, -60, 60))))


def train(rows: list[np.ndarray], y: np.ndarray, penalty: float = SWAP_PENALTY, said: list[list[tuple[int, ...]]] | None = None) -> Model:
    """Logistic regression over feature lists with a squared price on counterfactual gaps.

    ``said`` holds the terms of every text's sentences (``mentions``); without it every text is
    one sentence.  All else in a sentence is the same in its swap, so its score (as a log odds)
    changes by the terms' weights alone.  A text's sentences share one price.  Without rows, or with one label only, the score is the
    share of label 1 (0 without rows).
    """
    weight = np.zeros(SIZE, np.float64)
    if len(np.unique(y)) < 2:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        return Model(weight, float(np.log(share / (1 - share))))
    if said is None:
        said = [[tuple(int(f) - BUCKETS for f in r if f >= BUCKETS)] for r in rows]
    before, after, price = [], [], []
    for i, own in enumerate(said):
        for j, terms in enumerate(own):
            before.append(terms), after.append(swapped(terms, i + j)), price.append(1 / len(own))
    used = np.unique(np.concatenate([*rows, np.arange(BUCKETS, SIZE)]))
    place = np.full(SIZE, -1)
    place[used] = np.arange(len(used))

    def packed(lists: list) -> tuple[np.ndarray, np.ndarray]:
        each = [np.asarray(r, np.int64) for r in lists]
        return np.concatenate(each) if each else np.zeros(0, np.int64), np.repeat(np.arange(len(each)), [len(r) for r in each])

    at, of = packed(rows)
    (at1, of1), (at2, of2) = packed(before), packed(after)
    at, at1, at2, price = place[at], place[at1 + BUCKETS], place[at2 + BUCKETS], np.array(price)
    n, k, m_ = len(rows), len(used), len(price)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(of, weights=w[at], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        change = np.bincount(of1, weights=w[at1], minlength=m_) - np.bincount(of2, weights=w[at2], minlength=m_)
        gap = 2 * penalty * price * change
        g = (np.bincount(at, weights=error[of], minlength=k) + np.bincount(at1, weights=gap[of1], minlength=k) - np.bincount(at2, weights=gap[of2], minlength=k)) / n + RIDGE * w
        gb = error.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.08 * (1 - step / (STEPS + 1))
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    weight[used] = w
    return Model(weight, b)


def chosen_features(sample: DataFrame, kept: int = KEPT) -> np.ndarray:
    """The features most linked with the label in a labelled sample, and all identity terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray]:
        tables = {k: np.zeros(SIZE, np.int64) for k in ("0", "1", "rows")}
        for batch in text_chunks(batches):
            for y, own in zip(batch.column("y").to_pylist(), features(batch.column("text").to_pylist())):
                tables["1" if y else "0"][own] += 1
                tables["rows"][1 if y else 0] += 1
        return tables

    found = summed(sample.select("y", "text"), count, 1 << 14)
    table = {k: np.zeros(SIZE) for k in ("0", "1", "rows")}
    for k, t in found.items():
        table[k][: min(SIZE, len(t))] = t[:SIZE]
    no, yes = max(1.0, table["rows"][0]), max(1.0, table["rows"][1])
    both = table["0"] + table["1"]
    p = (both + 1) / (no + yes + 2)
    link = (table["1"] / yes - table["0"] / no) / np.sqrt(p * (1 - p) * (1 / yes + 1 / no))
    link[(both < LEAST_TEXTS) | (np.abs(link) < LEAST_LINK)] = 0
    link[BUCKETS:] = 0
    strong = np.argsort(-np.abs(link), kind="stable")[:kept]
    return np.sort(np.concatenate([strong[link[strong] != 0], np.arange(BUCKETS, SIZE)]))


def fit(docs: DataFrame, labels: DataFrame, keep, bound: int = SAMPLE_ROWS, penalty: float = SWAP_PENALTY) -> Model:
    """A model from at most ``bound`` labelled documents (see ``labelled_sample``)."""
    sample = labelled_sample(docs, labels, "toxic", keep, bound)
    allowed = np.zeros(SIZE, bool)
    allowed[chosen_features(sample)] = True
    sent = docs.sparkSession.sparkContext.broadcast(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = batch.column("text").to_pylist()
            blobs = [f.astype("<i4").tobytes() for f in features(texts, sent.value)]
            # Sentences with the same terms count by their number; there are few kinds.
            said = [[list(t) for t in own] for own in mentions(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(blobs, pa.binary()), pa.array(said, pa.list_(pa.list_(pa.int32())))], names=["y", "x", "said"])

    got = sample.select("y", "text").mapInArrow(run, "y int, x binary, said array<array<int>>").toArrow()
    # At most ``bound`` rows: sorted here, so that training sees them in one order.
    rows = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), ([tuple(t) for t in own] for own in got.column("said").to_pylist())))
    return train([np.frombuffer(x, "<i4").astype(np.int64) for x, _, _ in rows], np.array([y for _, y, _ in rows], np.float64), penalty, [own for _, _, own in rows])


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns and, last, ``score`` (``score_`` where a kept column has that name).

    Null and empty texts get the score of no words; a long text is read in segments, whole;
    repeated rows and null ids keep their rows; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([sent.value.score(f) for f in features(texts, sent.value.weight != 0)], pa.float64())]

    return with_outputs(docs, keep, {"score": "double"}, work)
