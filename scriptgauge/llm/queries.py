"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptgauge.llm import bitmix, byte_bpe, langid, lines, mixing, pieces, resample, runs, simhash, sketches, token_counts, vectors, warc
from scriptgauge.llm.common import settled, table
from scriptgauge.llm.sql import SQL  # noqa: F401

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKEN_LIMIT = 4096


def op1_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_vector_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op3_sketch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = sketches.compare_with_edit(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_classes(table(spark, folder, "documents")).drop("mark")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out").select("text", "lang"), langid.vocabulary(public_tokenizers.path(PIECES)))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.copies(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path(PIECES))
    told = pieces.decode(pieces.encode(table(spark, folder, "documents"), vocabulary, keep=("doc_id", "text")), vocabulary)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")), public_tokenizers.path(PIECES))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    marked = settled(simhash.fingerprints(table(spark, folder, "documents")), "fingerprints")
    return simhash.near_duplicates(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bit_mixing_scores(spark: SparkSession, folder: str) -> DataFrame:
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    told = bitmix.scored(docs, remainder != 2, remainder == 3)
    return told.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_byte_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    encoded = byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, keep=("doc_id",))
    told = byte_bpe.decode(encoded, ranks)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return runs.run_summary(runs.text_runs(docs, plant=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_vector_near_duplicates": op2_vector_near_duplicates,
    "op3_sketch_fingerprints": op3_sketch_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_piece_encoding": op7_piece_encoding,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_near_duplicates": op9_simhash_near_duplicates,
    "op10_bit_mixing_scores": op10_bit_mixing_scores,
    "op11_byte_bpe_round_trip": op11_byte_bpe_round_trip,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
