"""The ten operators as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path
from . import bpe, chat, covertree, langid, mixing, nearcopies, qalsh, quality, simhash, toxicity, warc
from .rows import column, held_out, with_row_ids

QUALITY_AT = 0.5
TOXIC_AT = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    langs, model = langid.fit(docs.where(~out))
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    return langid.predict(rows, langs, model, "doc_id", "held_out")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op3_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "archive")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.verified(warc.read(spark, folder))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), held_out(3, 1)
    vectors, net = quality.fit(docs, _table(spark, sf_dir, "labels"), ~out)
    scored = quality.score(docs.select("doc_id", "text", out.alias("held_out")), vectors, net, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_AT).cast("int"))


def op6_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), held_out(4, 2)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~out)
    scored = toxicity.score(docs.select("doc_id", "text", out.alias("held_out")), model, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(turns.unionByName(probe))


def op8_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qalsh.nearest(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, pattern or public_tokenizers.PATTERN)


# --- stages of the pipeline -----------------------------------------------------------


def _kept(scored: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """The documents' columns of the rows whose score, the last column, passes."""
    score = scored.columns[-1]
    return scored.where(keep(column(score))).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the model learns from this stage's input.

    Null and empty texts are judged as texts without words; repeated rows stay or go together;
    an empty table gives an empty one; other columns, of whatever name, are returned as they are.
    """
    vectors, net = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return _kept(quality.score(docs, vectors, net, *docs.columns), docs, lambda s: s >= QUALITY_AT)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; odd rows as in ``keep_quality``."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return _kept(toxicity.score(docs, model, *docs.columns), docs, lambda s: s < TOXIC_AT)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: the one with the smallest id.

    SimHash proposes over 5-word shingles; groups hang together by a Jaccard similarity of 0.8
    or more.  A null id comes after all others; of rows that repeat an id one stays.  Null
    texts and texts without words are one group; an empty table gives an empty one.
    """
    rows, rid = with_row_ids(docs)
    groups = nearcopies.near_copies(rows.select(column(rid).alias("_rid"), "text"), "_rid")
    ids = groups.join(rows.select(column(rid).alias("_rid"), "doc_id"), "_rid")
    kept = ids.groupBy("component_id").agg(F.min_by("_rid", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_rid"))).alias(rid)).select(column(rid))
    return rows.join(kept, rid, "left_semi").select([column(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; odd rows as in ``mixing.mixed_texts``."""
    return mixing.mixed_texts(*with_row_ids(docs))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of every document of the mix, with their count and digests."""
    import public_tokenizers

    return bpe.round_trip(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_source_mixing": op2_source_mixing,
    "op3_simhash_tiles": op3_simhash_tiles,
    "op4_content_addressed_warc": op4_content_addressed_warc,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity_classifier": op6_toxicity_classifier,
    "op7_chat_template": op7_chat_template,
    "op8_dual_tree_top_k": op8_dual_tree_top_k,
    "op9_collision_counting": op9_collision_counting,
    "op10_byte_bpe": op10_byte_bpe,
}

_ESCAPED = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

ORACLES = {
    "op4_content_addressed_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
          CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op7_chat_template": f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(3 + sum(6 + 7 + 4 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_dual_tree_top_k": """
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.own <> c.own
        ), r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
