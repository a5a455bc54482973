"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import embed_lattice, exact_dedup, language_id, line_dedup, merkle, mixing, ngram_join, packing, quality_rules, suffix_dedup, token_output, vector_codes, warc
from curata.llm.common import table
from curata.llm.tokens import vocabulary
from curata.session import shared_dir


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), vocabulary())


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_output.digest(token_output.read_tokens(spark, path))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "n_languages")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index, folder = warc.archive(pages)
    # every page is looked up by its URL
    return warc.read_archive(pages.select(warc.surt(F.col("url")).alias("key")), index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.deduplicate_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit("")).cast("binary")
    return cut.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.octet_length(kept).cast("long").alias("n_kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op8_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.decisions(docs, exact_dedup.insert(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.codebook_digest(codebooks)).alias("codebooks_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_output": op2_token_output,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_lattice": op8_embedding_lattice,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {
    "op6_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_vector_codes": vector_codes.oracle_sql(),
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
