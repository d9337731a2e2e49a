"""The training-data queries: one for each operator, over its whole table, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, ngram_join, pii, rolling_median, sharding, spelling, subspace_join, tiff, tokenpack, toxicity, warc
from .common import table

#: The key of the registered query's pseudonyms; a real one comes from a secret store.
DEMO_KEY = b"chronoweave demo key"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.encode_texts(table(spark, sf_dir, "documents"))
    with_digest = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = tiff.payload_digests(tiff.tiff_pages(with_digest))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "compression", "predictor", "pages")


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenpack.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = ~toxicity.held_out()
    model = toxicity.fit(docs.where(train), table(spark, sf_dir, "labels").where(train))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median.rolling_medians(table(spark, sf_dir, "clicks"))


def op12_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_tiff_media, op3_warc_captures, op4_jump_shards, op5_token_pack, op6_ngram_join, op7_toxicity, op8_decontamination, op9_mixing, op10_pseudonyms, op11_rolling_median, op12_embedding_join, op13_spelling_variants, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_captures": warc.OP3_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op8_decontamination": decontam.OP8_SQL, "op9_mixing": mixing.OP9_SQL, "op11_rolling_median": rolling_median.OP11_SQL, "op12_embedding_join": subspace_join.OP12_SQL}
