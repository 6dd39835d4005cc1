"""Registered queries of this package: one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import (decontaminate, filter_audit, html_text, language_id, licences, mixing, pieces, pivot_clusters, sharding,
                         simhash, token_files, vector_dups, warc)
from ragloom.llm.common import cut, input_table, remove, scratch
from ragloom.llm.oracles import statements


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives, read back and reassembled."""
    path = scratch(spark, "archives")
    warc.write_archives(input_table(spark, sf_dir, "pages"), path)
    found = warc.reassembled(warc.read_records(spark, path))
    full = F.col("payload")
    rows = cut(found.select(
        "page_id", F.coalesce(F.octet_length(full).cast("long"), F.col("bytes")).alias("payload_bytes"),
        F.coalesce(warc.base32_sha1(full), F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to"))
    remove(spark, path)  # what was read is checkpointed
    return rows


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(input_table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document a mix with weighted sources takes."""
    return mixing.mix(input_table(spark, sf_dir, "documents")).drop("copies")


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` with the shared vocabulary, read them back, delete them."""
    import public_tokenizers

    path = scratch(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    found = token_files.read_documents(spark, path)
    remove(spark, path)  # what was read is checkpointed
    return found


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.with_main_text(input_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files written of all."""
    return token_rows(spark, input_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and component of every vector."""
    return vector_dups.near_duplicates(input_table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words, items and verdict of every document."""
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, input_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[f"hits.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that states a licence, with its family, probability and confirming template."""
    return licences.scan(input_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place_documents(input_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds, with inertias and the digest of its centroid."""
    return pivot_clusters.cluster(input_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at every step of every order, by language."""
    return filter_audit.audit(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids of every document and of the text decoded from them."""
    import public_tokenizers

    return pieces.digests(input_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_warc,
    op2_simhash_near_dedup,
    op3_source_mixing,
    op4_html_text,
    op5_token_files,
    op6_embedding_near_dedup,
    op7_decontamination,
    op8_language_id,
    op9_licence_scan,
    op10_sharding,
    op11_centroid_clustering,
    op12_filter_audit,
    op13_sentence_pieces,
)}


def oracles() -> dict[str, str]:
    return statements()
