"""One awkward table through every operator and stage: nulls, empty and long texts, ties, repeated
rows, no rows, and extra columns whose names clash with the operators' own."""

import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, covertree, langid, mixing, nearcopies, qalsh, quality, queries, simhash, toxicity, warc
from orrery.llm.rows import with_row_ids
from orrery.shared import fresh_path

CLASH = ["score", "_text", "size", "_rid", "parts", "copy", "got", "_words", "lang_pred", "lang_shares", "k0", "o0", "_row", "key", "node", "fp", "y", "x", "run", "nth", "a b", "c.d", "tile", "_kept"]
LONG = "mot " * 3000 + "x" * 1_200_000 + " fin"
TEXTS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "12 !!", "en", None), (4, "One two three. Four five!", "en", "a"), (4, "One two three. Four five!", "en", "a"), (4, "One two three. Four five!", "fr", "a"),
    (None, "One two three. Four five!", None, "b"), (None, None, "de", "b"), (6, "wort " * 30_000, "de", "b"), (7, "été œuf 漢字 \U0001f600 don't", "fr", "c"), (8, LONG, "fr", "c"), (9, " \t\n", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, len(t[1]) if t[1] else None, *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3, F.col("k0"))


def extras(df):
    return sorted(map(str, df.select(*(F.col(f"`{c}`") for c in CLASH)).collect()))


def test_classifiers_keep_clashing_columns(spark, docs, tmp_path):
    labels = spark.createDataFrame([(2, 1, 0, "s"), (4, 0, 1, "s"), (4, 1, 1, "s"), (None, 1, 1, "s"), (7, 1, 0, "s"), (6, 0, 1, "s")], "doc_id long, quality int, toxic int, score string")
    made = [langid.predict(docs, *langid.fit(docs), *docs.columns), quality.score(docs, *quality.fit(docs, labels, F.lit(True)), *docs.columns), toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)), *docs.columns)]
    for df, names in zip(made, (["lang_pred_", "score_", "lang_shares_"], ["score_"], ["score_"])):
        assert df.columns == [*docs.columns, *names] and extras(df) == extras(docs)
        assert df.where("score_ between 0 and 1").count() == len(TEXTS)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (queries.keep_quality, queries.keep_civil):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and set(extras(out)) <= set(extras(docs))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_and_stage(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) and {r.component_id for r in got if r.doc_id in (1, 2, 9)} == {1}
    kept = queries.keep_distinct(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "7", "8"]
    assert queries.keep_distinct(spark, docs.limit(0), "").count() == 0
    rows, rid = with_row_ids(docs)
    assert rid == "_rid_" and extras(rows) == extras(docs)


def test_half_of_the_hashes_is_not_more_than_half():
    import numpy as np

    assert int(simhash.bits(np.array([0b11, 0b01], np.uint64))[0]) == 0b01


def test_mix(spark, docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(TEXTS) and all(r.taken <= 2 * r["size"] for r in got) and all(r.taken == 0 for r in got if r["size"] == 0)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    mix = queries.mix_sources(spark, docs, "")
    assert mix.columns == docs.columns and set(extras(mix)) <= set(extras(docs))
    assert mix.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert queries.mix_sources(spark, docs.limit(0), "").count() == 0


def test_equal_rows_are_spread(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.mixed(df)
    assert got.agg(F.sum("taken")).first()[0] == 13500 and got.count() == 3000
    sizes = mixing.stored_sizes(df.repartition(4)).withColumn("nth", F.lit(1).cast("long"))
    assert sorted(r[0] for r in mixing._numbered(sizes).select("copy").collect()) == list(range(3000))


def test_bytes_round_trip(spark, docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(docs, path, P.PATTERN, with_ids=True)
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d"))
    assert out.select("doc_id", F.col("decoded_sha256").alias("d")).exceptAll(texts).count() == 0 and out.count() == len(TEXTS)
    empty = bpe.round_trip(docs.limit(0), path, P.PATTERN, with_ids=True)
    assert empty.columns == out.columns and empty.count() == 0


def test_long_texts_are_encoded_in_parts(monkeypatch, spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, "ab cd's 12345  \n\n x" * 50), (2, "x")], "doc_id long, text string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    codec = bpe.Codec(bpe.model_bytes(ranks), ranks, P.PATTERN)
    want = codec.encode([r.text for r in df.collect()])
    monkeypatch.setattr(bpe, "LONG_CHARS", 40)
    assert codec.encode([r.text for r in df.collect()]) == want


def test_archive(spark, tmp_path):
    big = "é" * 400_000
    rows = [(1, "u", big, "a"), (2, "v", big, "b"), (2, "v", big, "b"), (3, None, None, "c"), (4, "w", "", "d"), (None, "w", big, "e"), (None, None, "solo " * 50, "f"), (None, "z", "solo " * 50, "g")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumns({c: F.lit(1) for c in ("salt", "lot", "revisit", "second")})
    folder = fresh_path(spark, "awkward")
    warc.write(pages, folder)
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.verified(warc.read(spark, folder)).collect()]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    want = [(1, 800_000, "response", None), (2, 800_000, "revisit", 1), (2, 800_000, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (None, 800_000, "revisit", 1), (None, 250, "response", None), (None, 250, "response", None)]
    assert sorted(got, key=lambda t: str(key(t))) == sorted(want, key=lambda t: str(key(t)))


def test_damage_is_found(spark, tmp_path):
    folder = fresh_path(spark, "damaged")
    warc.write(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), folder)
    record = bytes(warc.read(spark, folder).first().record)
    warc.parse_record(record)
    for bad in (record.replace(b"xx", b"xy", 1), record.replace(b"xx", b"x", 1), record[:-1], record.replace(b"WARC/1.1", b"WARC/0.9"), record.replace(b"Content-Type", b"Content Type", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"said {t} " * 20, "x") for t in range(3000)] + [(c, 0, "user", None, "x") for c in range(2, 2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.read_back(df).collect()}
    assert len(got) == 2499 and got[1].n_turns == 3000 and got[7].loss_chars == 0


def test_searches_with_extra_columns(spark):
    rows = [(i, [float(i % 7), 1.0], "s") for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").withColumns({c: F.lit("z") for c in ("id", "dim", "v", "own", "block", "cell")})
    assert covertree.top_k(df, 20, 3).count() == 15 and qalsh.nearest(df, 20, 3).count() == 15


def test_fingerprint_lanes_are_zero_for_no_shingles():
    import numpy as np

    assert nearcopies.fingerprint(np.zeros(0, np.uint64)) == bytes(32)
