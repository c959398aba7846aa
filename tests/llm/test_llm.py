"""The ten operators: against brute force, round trips, held-out rows and awkward input."""

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, covertree, langid, mixing, qalsh, quality, queries, simhash, toxicity, warc
from orrery.shared import fresh_path

from ..conftest import SF
from .test_near_copies import brute_kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, key string"
ODD = [
    (1, None, None, None, None, 1, "k"), (2, "", "en", "a", 0, 1, "k"), (3, "12 !!", "en", None, 5, 1, "k"), (4, "one two three four", "en", "a", 18, 1, "k"), (4, "one two three four", "en", "a", 18, 1, "k"),
    (None, "ONE two\tthree  four", None, "b", 9, 1, "k"), (6, "wort " * 40000, "de", "b", 9, 1, "k"), (7, "été œuf 漢字 \U0001f600 don't", "fr", "c", 9, 1, "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_and_odd(spark, odd):
    got = queries.op1_language_mixture(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    out = got[got.held_out]
    assert len(got) == 200 and (out.lang_pred == out.lang).mean() > 0.95 and got.score.between(0, 1).all()
    langs, model = langid.fit(odd)
    rows = langid.predict(odd, langs, model, "doc_id").collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3 and len(rows) == len(ODD)
    assert langid.predict(odd, *langid.fit(odd.limit(0)), "doc_id").where("lang_pred <> 'und'").count() == 0


def test_language_mixture_of_two():
    rng = np.random.default_rng(0)
    model = np.log(np.stack([np.where(np.arange(langid.BUCKETS) % 2 == k, 3.0, 1e-6) for k in (0, 1)], axis=1) / langid.BUCKETS / 1.5)
    text = "".join(rng.choice(list("abcdefghijklmnop"), 4000))
    share = langid.infer(text, model)
    even = (langid.grams(text) % 2 == 0).mean()
    assert abs(share[0] - even) < 0.02 and langid.infer("12 3", model) is None


def test_mix_meets_targets(spark, docs, odd):
    got = mixing.mixed(docs).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), own=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all() and (got.taken <= 2 * got["size"]).all() and len(got) == 200
    assert abs(per.target.sum() / per.own.sum() - 1.5) < 1e-9
    again = mixing.mixed(docs.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    strange = mixing.mixed(odd).toPandas()
    assert len(strange) == len(ODD) and (strange.taken <= 2 * strange["size"]).all()
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_mixed_texts_have_the_taken_words(spark, docs):
    taken = mixing.mixed(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"))
    texts = queries.mix_sources(spark, docs, SF).groupBy("doc_id").agg(F.sum(mixing.words(F.col("text"))).alias("got"))
    both = taken.join(texts, "doc_id", "left").where("taken <> coalesce(got, 0)")
    assert both.count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        p = spark.range(n).select(F.col("id"), mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        p = p.withColumn("back", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(3), back=True)).toPandas()
        assert sorted(p.p) == list(range(n)) and (p.back == p.id).all()


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, f"near copy {'word ' * 50} tail {i // 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [int(got[i].fingerprint, 16) for i, _ in rows] == fps
    assert [got[i].component_id for i, _ in rows] == brute_components(fps, [i for i, _ in rows])
    strange = simhash.near_duplicates(odd).collect()
    assert len(strange) == len(ODD) and {r.component_id for r in strange if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_tiles_are_split_and_joined(monkeypatch, spark):
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    fps = sorted({int(b) ^ int(1 << int(k)) for b in base for k in rng.integers(0, 62, 6)})
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    from orrery.operators.graph import connected_components

    label = {r.node: r.label for r in connected_components(links).collect()}
    got = [label.get(f, f) for f in fps]
    want = brute_components(fps, fps)
    assert got == want


def test_warc_round_trip(spark):
    big = "x" * 150
    pages = spark.createDataFrame([(1, "u", big), (2, "v\r\nq", big), (3, None, None), (4, "w", "short"), (5, "w", "short"), (5, "w", "short"), (None, "n", big)], "page_id long, url string, html string")
    folder = fresh_path(spark, "t")
    warc.write(pages, folder)
    got = {r.page_id: r for r in warc.verified(warc.read(spark, folder)).collect()}
    assert got[2].record_type == "revisit" and got[2].refers_to == 1 and got[None].refers_to == 1 and got[1].refers_to is None
    assert got[3].payload_bytes == 0 and got[4].record_type == got[5].record_type == "response"
    assert got[2].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    records = [bytes(r.record) for r in warc.record_bytes(warc.read(spark, folder)).collect()]
    for r in records:
        head, _, body = r.partition(b"\r\n\r\n")
        assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(body) - 4 and body.endswith(b"\r\n\r\n")
    warc.export_files(warc.read(spark, folder), folder + "/files", codec="none")
    back = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(folder + "/files").select("content").collect())
    assert sorted(back.split(b"WARC/1.1")) == sorted(b"".join(records).split(b"WARC/1.1"))
    warc.write(pages.limit(0), folder + "/none")
    assert warc.read(spark, folder + "/none").count() == 0


def test_quality_held_out(spark):
    got = queries.op5_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.93 and got.score.between(0, 1).all()


def test_toxicity_held_out_and_swaps(spark):
    got = queries.op6_toxicity_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.9
    texts = [f"the {g} are {w} people here {i}" for i in range(40) for g, w in (("women", "awful"), ("men", "nice"), ("jews", "nice"), ("women", "awful"))]
    y = np.array([1.0 if "awful" in t else 0.0 for t in texts])
    feats = toxicity.features(texts)
    gap = {p: abs(np.subtract(*(toxicity.train(feats, y, p).score(f) for f in toxicity.features(["the women are here", "the men are here"])))) for p in (0.0, 5.0)}
    assert gap[5.0] < gap[0.0] / 3


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit, quality.score), (toxicity.fit, toxicity.score)):
        for some in (labels, labels.limit(0)):
            made = fit(odd, some, F.lit(True))
            made = made if isinstance(made, tuple) else (made,)
            assert score(odd, *made, "doc_id").where("score between 0 and 1").count() == len(ODD)
        assert score(odd.limit(0), *made, "doc_id").count() == 0


def test_template_language():
    run = lambda s, **v: "".join(t for t, _ in chat.compile_template(s)(v))
    assert run("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b"]) == "1A,2B"
    assert chat.fold(chat.parse("a{{ 'b' ~ (1 + 2) }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}")) != () and run("{{ 'a' ~ 'b' }}") == "ab"
    assert chat.fold(chat.parse("a{{ 'b' }}c")) == (chat.Text("abc"),)
    assert run("{% set y = m['k'] %}{{ y | default('none') }}{# gone #}", m={}) == "none"
    assert run("{{ m.__class__ }}", m={}) == "" and run("{{ x.__class__ }}", x="s") == ""
    for bad in ("{% if x %}", "{{ x( ) }}", "{{ x | open }}", "{% endfor %}", "{{ 'a }}", "{% exec x %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for text in ("</s>", "\\", "[INST]\\[/INST]", "<\\s>", "<<s>", "\\\\</s>", "["):
        assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))


def test_chat_rows(spark):
    rows = [(1, 1, "user", "a</s>"), (1, 0, None, None), (1, 2, "assistant", "[INST]\\"), (None, None, "user", "x"), (1, 2, "assistant", "[INST]\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(df).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256("\n\nuser\na</s>\nassistant\n[INST]\\\nassistant\n[INST]\\\n".encode()).hexdigest()
    assert got[1].loss_chars == 14 and got[None].n_turns == 1
    pieces = chat.format_conversations(df).where("conv_id = 1").orderBy("piece").collect()
    assert sum(len(p.text) for p in pieces) == got[1].formatted_chars and chat.read_back(df.limit(0)).count() == 0


def _vectors(spark, n=700):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 16))
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 16), (903, [0.0] * 16), (None, [1.0] * 16), (904, [])]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("orrery.llm.vectors.BLOCK_ROWS", 200)
    monkeypatch.setattr(covertree, "LEAF", 16)
    v, df = _vectors(spark)
    x = np.floor(64 * np.vstack([v, np.zeros((1, 16))]).astype(np.float32).astype(float)).astype(int)
    ids = np.array([*range(len(v)), 903])
    got = covertree.top_k(df, 20, 20).toPandas()
    for q, part in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        want = sorted((-int(a), int(i)) for a, i in zip(s, ids) if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in part.sort_values("rank").itertuples()] == want
    assert got.query_id.nunique() == 35 and covertree.top_k(df.limit(0), 20, 20).count() == 0


def test_neighbours_recall(spark):
    v, df = _vectors(spark)
    v = v.astype(np.float32).astype(float)
    got = qalsh.nearest(df, 100, 10).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hit += len(set(want) & set(part.vec_id))
        assert np.allclose(part.score, d[part.vec_id])
    assert hit / 70 >= 0.9 and 903 not in set(got.vec_id)


def test_bpe_is_tiktoken(spark, odd, docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    noise = ["".join(chr(int(c)) for c in rng.integers(0, 0xD7FF, 60)) for _ in range(60)] + ["\x00\x00", "▁ ▁", " \n \n", "a" * 5000]
    more = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        got = bpe.encode(df, path, P.PATTERN).collect()
        texts = [r.text or "" for r in df.collect()]
        assert sorted(map(str, (list(r.ids) for r in got))) == sorted(map(str, map(other.encode_ordinary, texts)))
        back = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
        assert sorted(bytes(r.data) for r in back) == sorted(t.encode() for t in texts)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "mixing sources", "byte-level bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = queries.keep_distinct(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    out = c.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert out.where("n_tokens <> size(ids) or ids_sha256 <> sha2(array_join(transform(ids, x -> cast(x as string)), ','), 256)").count() == 0
