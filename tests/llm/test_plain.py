"""Operators that SQL cannot express against plain, slow versions of the same rules."""

import itertools
import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from orrery.llm import langid, mixing, quality, queries, toxicity
from orrery.llm.tokens import SEGMENT_BYTES, segments

from ..conftest import SF


def test_language_sets_against_all_subsets():
    """The chosen set is that of highest penalised likelihood among all sets (small tables)."""
    rng = np.random.default_rng(4)
    profile = rng.dirichlet(np.full(langid.BUCKETS, 0.02), 3).T + 1e-9
    model = np.log(profile / profile.sum(axis=0)).astype(np.float32)
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    for trial in range(12):
        text = "".join(rng.choice(alphabet, 300 * (trial + 1)))
        found = Counter(langid.grams(text).tolist())
        n = {g: c * langid.GRAM_WEIGHT for g, c in found.items()}
        cost = langid.PENALTY * 0.5 * math.log(sum(n.values()) + 1.0)
        best = None
        for size in (1, 2, 3):
            for own in itertools.combinations(range(3), size):
                share = [1 / size] * size
                like = {g: [math.exp(float(model[g, k])) for k in own] for g in n}
                for _ in range(langid.EM_STEPS):
                    new = [0.0] * size
                    for g, c in n.items():
                        total = sum(a * b for a, b in zip(share, like[g]))
                        for k in range(size):
                            new[k] += c * share[k] * like[g][k] / total
                    share = [x / sum(n.values()) for x in new]
                value = sum(c * math.log(sum(a * b for a, b in zip(share, like[g]))) for g, c in n.items()) - cost * (size - 1)
                if best is None or value > best[0] + 1e-6:
                    best = (value, own, share)
        got = langid.infer(text, model)
        assert tuple(np.flatnonzero(got)) == best[1] and np.allclose(got[list(best[1])], best[2], atol=1e-3)


def test_long_texts_are_counted_whole(monkeypatch):
    text = "un été, deux étés. " * 400
    want = np.bincount(langid.grams(text), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "PIECE_CHARS", 50)
    assert (langid.counted(text) == want).all()


def spark_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def test_mix_against_plain_filling_and_walk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")])) for r in docs.collect()]
    own = Counter()
    for _, _, s, n in rows:
        own[s] += n
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(own.values())
    while free:  # fill by weight; cut who is above twice its size; deal the excess again
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * own[s] <= unit * weight[s]}
        for s in over or free:
            target[s] = 2.0 * own[s] if over else unit * weight[s]
            left -= target[s]
        free -= over or free
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == own[r.source] for r in got.values())

    sources, drawn, _ = mixing.mix(mixing.stored_sizes(docs))
    nth = {r.source: r.nth for r in sources.collect()}
    slots = drawn.collect()
    runs = max(1, -(-len(rows) // mixing.RUN_ROWS))
    taken = Counter()
    for s in order:
        copies, stream = Counter(), []
        keyed = []
        for doc_id, text, source, n in rows:
            if source == s:
                tie = spark_hash(text)
                copy = copies[doc_id, tie]
                copies[doc_id, tie] += 1
                run = spark_hash(doc_id, tie, copy, np.int32(mixing.SEED)) % runs
                keyed.append((run, spark_hash(doc_id, tie, copy), doc_id, n))
        for _, _, doc_id, n in sorted(keyed):
            stream += [doc_id] * n
        mine = [x for x in slots if x.nth == nth[s]]
        assert sum(x.words for x in mine) == min(2 * own[s], math.floor(target[s] + 0.5))
        assert sorted(x.slot for x in mine) == list(range(len(mine)))  # no slot twice, none left out
        assert all(c == 1 for c in Counter((x["pass"], x.block) for x in mine).values())
        for x in mine:
            at = x.block * mixing.BLOCK_WORDS
            taken.update(stream[at : at + x.words])
    assert {d: r.taken for d, r in got.items() if r.taken} == dict(taken)


def plain_tokens(text):
    kind = lambda b: 0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    out = []
    for b in text.encode():
        if out and out[-1] and kind(out[-1][-1]) == kind(b) and kind(b):
            out[-1].append(b)
        elif kind(b):
            out.append([b])
        else:
            out.append([])
    return [bytes(t) for t in out if t]


def test_tokens_do_not_depend_on_the_cuts(monkeypatch):
    import orrery.llm.tokens as t

    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ab1! é\n"), 3000)) + "z" * 900 + "Ab9" * 200
    def read(size, longest):
        monkeypatch.setattr(t, "SEGMENT_BYTES", size)
        monkeypatch.setattr(t, "TOKEN_BYTES", longest)
        return [(int(d), int(h)) for own in t.segments([text, None, "x y"]) for d, h in zip(own.doc, own.hashes(own.start, own.end))]

    whole = read(SEGMENT_BYTES, 1 << 30)
    assert len([d for d, _ in whole if d == 0]) == len(plain_tokens(text))
    for size in (70, 333, 1000):
        assert read(size, 64) == read(SEGMENT_BYTES, 64)


def test_word_vectors_and_pooling_plainly(spark, monkeypatch):
    texts = ["Aa bb, 12 cc bb", "BB aa aa", None, "", "bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place, sign = quality.index_vectors()
    bucket = {}
    for own in segments(texts):
        words = quality.buckets(own)
        for i in range(len(words)):
            bucket.setdefault(int(own.doc[i]), []).append(int(words[i]))
    table = np.zeros((quality.BUCKETS, quality.DIM))
    for words in bucket.values():
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if i != j:
                    for p, s in zip(place[words[j]], sign[words[j]]):
                        table[w, p] += s
    want = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(df)
    assert np.allclose(got, want, atol=1e-6)
    import orrery.llm.tokens as t

    monkeypatch.setattr(t, "SEGMENT_BYTES", 8)  # context reaches over the cuts of a long text
    same = [quality.buckets(o).tolist() for o in t.segments([texts[0]])]
    assert sum(map(len, same)) == len(bucket[0]) and len(same) > 1
    x = quality.pooled(texts, got)
    for i, words in bucket.items():
        n = Counter(words)
        assert np.allclose(x[i, : quality.DIM], sum(c * got[w] for w, c in n.items()) / len(words), atol=1e-5)
        assert np.allclose(x[i, quality.DIM : 2 * quality.DIM], sum(got[w] for w in n) / len(n), atol=1e-5)
    assert not x[2].any() and not x[3].any()


def test_network_steps_lower_the_loss_and_calibrate():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    p = 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1])))
    y = (rng.random(2000) < p).astype(float)
    net = quality.train(x, y)
    made = net.score(x)
    loss = lambda q: float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    assert loss(np.clip(made, 1e-9, 1 - 1e-9)) < 1.15 * loss(p)
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (made >= lo) & (made < lo + 0.25)
        assert abs(made[own].mean() - y[own].mean()) < 0.08


def plain_gradient(rows, y, said, w, b, penalty):
    """Loss of the counterfactual classifier, written out; its gradient by differences."""
    total = 0.0
    for i, own in enumerate(rows):
        z = b + sum(w.get(f, 0.0) for f in own)
        total += math.log(1 + math.exp(-z if y[i] else z)) / len(rows)
        for j, terms in enumerate(said[i]):
            gap = sum(w.get(toxicity.BUCKETS + t, 0.0) for t in terms) - sum(w.get(toxicity.BUCKETS + t, 0.0) for t in toxicity.swapped(terms, i + j))
            total += penalty * gap * gap / len(said[i]) / len(rows)
    return total + toxicity.RIDGE / 2 * sum(v * v for v in w.values())


def test_counterfactual_loss_is_at_its_least():
    texts = [f"{a} {b}." for a in ("the women are", "the men are", "they are", "the muslims. we are") for b in ("awful", "nice", "awful people", "here")]
    y = np.array([1.0 if "awful" in t or ("women" in t and "here" in t) else 0.0 for t in texts])
    rows, said = toxicity.features(texts), toxicity.mentions(texts)
    model = toxicity.train(rows, y, 1.0, said)
    w = {int(f): float(model.weight[f]) for f in np.flatnonzero(model.weight)}
    at = plain_gradient(rows, y, said, w, model.bias, 1.0)
    for f in list(w)[:12] + [f for f in w if f >= toxicity.BUCKETS][:6]:
        for step in (-0.05, 0.05):
            assert plain_gradient(rows, y, said, {**w, f: w[f] + step}, model.bias, 1.0) > at - 2e-4


def test_sentences_and_their_swaps():
    assert toxicity.sentences("One. Two! Three?\nfour") == ["One.", "Two!", "Three?", "four"]
    women, men = toxicity._TERMS.index("women"), toxicity._TERMS.index("men")
    assert toxicity.mentions(["The women came. All men and the women left. Nobody.", "None here.", None]) == [[(women,), (women, men)], [()], [()]]
    group = len(toxicity.IDENTITY["en"])
    assert all(toxicity.swapped((women,), t) != (women,) and toxicity.swapped((women,), t)[0] < group for t in range(40))


def test_penalty_lowers_false_positives_on_neutral_mentions():
    """A group that goes with abuse in the labels: neutral mentions of it are let be."""
    rng = np.random.default_rng(11)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(60)]
    def text(group, bad):
        own = [words[int(i)] for i in rng.integers(0, 60, 6)]
        return f"The {group} {' '.join(own[:3])}. Then {' '.join(own[3:])} {'vile' if bad == 1 else 'scum' if bad == 2 else 'fine'}."
    texts = [text("muslims" if i % 10 < 8 else "christians", 1 + i % 2 if i % 20 else 0) for i in range(300)] + [text("christians" if i % 10 < 8 else "hindus", 0) for i in range(300)]
    y = np.array([1.0] * 300 + [0.0] * 300)
    rows, said = toxicity.features(texts), toxicity.mentions(texts)
    neutral = toxicity.features([text("muslims", 0) for _ in range(200)])
    abuse = toxicity.features([text(g, 1) for g in ("women", "christians", "muslims", "hindus") for _ in range(50)])
    wrong, caught = {}, {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        model = toxicity.train(rows, y, penalty, said)
        wrong[penalty] = np.mean([model.score(f) >= queries.TOXIC_AT for f in neutral])
        caught[penalty] = np.mean([model.score(f) >= queries.TOXIC_AT for f in abuse])
    assert wrong[toxicity.SWAP_PENALTY] < 0.5 * wrong[0.0] and caught[toxicity.SWAP_PENALTY] >= 0.95, (wrong, caught)


def test_toxic_rows_are_found_and_clean_ones_left(spark):
    got = queries.op6_toxicity_classifier(spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 1).mean() < 0.02


def test_features_plainly():
    text = "The flowers, the Flowers... 12 sun"
    want = defaultdict(int)
    for own in segments([text.lower()]):
        own = own.where(own.kind == 1)
        for a, b in zip(own.start, own.end):
            want[int(own.hashes(np.array([a]), np.array([b]))[0] % np.uint64(toxicity.BUCKETS))] += 1
            for n in toxicity.STEMS:
                if b - a > n:
                    want[int(own.hashes(np.array([a]), np.array([a + n]), salt=n)[0] % np.uint64(toxicity.BUCKETS))] += 1
    assert toxicity.features([text])[0].tolist() == sorted(want)
