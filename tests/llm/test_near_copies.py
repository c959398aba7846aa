"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

from collections import Counter, defaultdict

import numpy as np

from orrery.llm import queries

SF = "/root/testdata/sf0.01"


def brute_kept(rows):
    """Smallest id of every component of pairs with similarity >= 0.8, without hashes."""
    sets, owners = [], defaultdict(list)
    for i, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
        for s in sets[-1]:
            owners[s].append(i)
    common = Counter((a, b) for o in owners.values() for k, a in enumerate(o) for b in o[k + 1 :])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    return sorted(min(g) for g in groups.values())


def test_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in queries.keep_distinct(spark, docs, SF).collect()) == want


def test_pairs_around_the_threshold_and_chains(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three"]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 80)]
        texts.append(" ".join(base))
        for n in (1, 2, 4, 6, 8, 9, 10, 12):  # words cut from the end and put in anew: similarity 0.97 to 0.73
            texts.append(" ".join(base[:-n] + [f"x{x}" for x in rng.integers(0, 5000, n)]))
    shared = [f"c{x}" for x in range(70)]
    texts += [" ".join(shared + [f"t{i}x{x}" for x in range(20)]) for i in range(60)]  # one long passage, similarity 0.62
    texts += [" ".join(shared + ["last", f"v{i}"]) for i in range(60)]  # a large group of near copies
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in queries.keep_distinct(spark, df, SF).collect())
    assert got == brute_kept(list(enumerate(texts)))
    assert queries.keep_distinct(spark, df.limit(0), SF).count() == 0


def test_lots_and_shares_lose_no_link(spark, monkeypatch):
    """A family of texts around one passage, held and streamed a few at a time."""
    from orrery.llm import nearcopies

    monkeypatch.setattr(nearcopies, "HELD", 3)
    monkeypatch.setattr(nearcopies, "STREAMED", 5)
    rng = np.random.default_rng(17)
    shared = [f"c{x}" for x in range(70)]
    texts = []
    for i in range(30):
        own = shared + [f"t{i}x{x}" for x in range(14)]
        texts.append(" ".join(own))
        if i % 3 == 0:
            texts.append(" ".join(own[:-1] + [f"y{int(rng.integers(0, 9))}"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in queries.keep_distinct(spark, df, SF).collect()) == brute_kept(list(enumerate(texts)))
