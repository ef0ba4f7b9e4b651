"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkeep.llm import sql
from emberkeep.llm.bottomk import bottomk_near_duplicates
from emberkeep.llm.languages import fit_languages, identify_languages
from emberkeep.llm.languages import held_out as held_out_language
from emberkeep.llm.lexicon_bpe import encode_words
from emberkeep.llm.merkle import digest, fold_path, leaf_digest, merkle_manifest, proof_text
from emberkeep.llm.mixing import mix_sources
from emberkeep.llm.notices import scan_notices
from emberkeep.llm.suffix_dedup import remove_repeats
from emberkeep.llm.toxicity import fit_toxicity, held_out, score_toxicity
from emberkeep.llm.url_reputation import UrlRule, filter_urls
from emberkeep.llm.vector_codes import books_sha256, code_vectors, with_label_totals
from emberkeep.llm.vector_dedup import near_duplicate_vectors
from emberkeep.llm.vector_search import nearest_neighbours
from emberkeep.llm.wavelet import read_shards, write_shards
from emberkeep.session import work_dir

URL_RULES = [
    UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"),
]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(_table(spark, sf_dir, "documents")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    write_shards(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, path)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_words(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk_near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = code_vectors(_table(spark, sf_dir, "embeddings"))
    return with_label_totals(coded).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle_manifest(docs, carry=leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], altered))
    folded = rows.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), fold_path(F.col("carried"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labelled = identify_languages(docs, fit_languages(docs))
    return labelled.select("doc_id", held_out_language(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def queries() -> dict[str, Query]:
    numbered = (
        op1_suffix_array_dedup, op2_url_reputation, op3_license_scan, op4_toxicity, op5_mix_to_weights, op6_wavelet_tokens, op7_embedding_near_dedup, op8_bpe_lexicon,
        op9_minhash_near_dedup, op10_nearest_neighbours, op11_vector_codes, op12_merkle_manifest, op13_language_id,
    )
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_reputation": sql.URL_REPUTATION, "op9_minhash_near_dedup": sql.NEAR_DEDUP, "op11_vector_codes": sql.VECTOR_CODES, "op12_merkle_manifest": sql.MERKLE}
