"""From raw documents to encoded training text: a chain of stages, each written and read again.

A stage takes all that its predecessor kept and returns the columns of documents;
the last one returns the encoded texts. Nulls, empty texts, repeated rows and extra
columns pass as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptgauge.llm import langid, lines, mixing, pieces, simhash
from scriptgauge.llm.common import settled, table

PIECES = "piece_bpe_32k.model"
#: A document goes if no language, or none with this posterior, fits it.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; learned from all labelled documents."""
    model = langid.fit(docs.select("text", "lang"), langid.vocabulary(public_tokenizers.path(PIECES)))
    told = langid.predict(docs, model, label="__lang", score="__score")
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that are near an earlier one; documents of nothing else go."""
    return _measured(lines.without_repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id (null ids last; of equal ids, one)."""
    keyed = docs.withColumn("__mark", F.xxhash64("text"))
    marked = settled(simhash.fingerprints(keyed, keep=("doc_id", "__mark"), into="fp"), "fingerprints")
    groups = simhash.near_duplicates(marked)
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__mark")).alias("first"))
    first = chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.__mark").alias("__first"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text: ``(doc_id, lang, source, n_pieces, ids)``."""
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path(PIECES))
    encoded = pieces.encode(docs, vocabulary, keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
