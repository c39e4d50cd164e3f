"""The training-data pipeline over documents: quality, lines, near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cubewright.llm.common import drop_staged, staged, staged_paths, table
from cubewright.llm.line_dedup import dedup_lines
from cubewright.llm.ngram_join import ngram_jaccard_components
from cubewright.llm.packing import pack_documents
from cubewright.llm.pii import redact_pii
from cubewright.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(df: DataFrame) -> DataFrame:
    """The columns of documents, and no others, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and of the others the lines that fail.

    Null and empty texts have no words and go; rows that repeat an id are judged each.
    """
    judged = quality_rules(docs, keep_cols=[c for c in COLUMNS if c not in ("text", "n_chars")])
    return _sized(judged.where("kept").withColumnRenamed("clean_text", "text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last of them; documents left without a word go.

    A null id counts as no document; rows that repeat an id count as one.
    """
    return _sized(dedup_lines(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays.

    Rows that repeat an id are one document and stay or go together; null ids link nothing and stay.
    """
    groups = ngram_jaccard_components(docs, shingle_words=5, threshold_pct=80)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; null texts stay null."""
    return _sized(redact_pii(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens.

    A null or empty text is one piece, the end token; each row gives its own pieces.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_copy_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokenizing, near copies and the span classifier can't be said in SQL; the tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has staged goes as soon as its result is written. An
    empty table gives an empty result; columns beside those of documents go with the first stage."""
    docs, before = table(spark, sf_dir, "documents"), staged_paths()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(spark, [*before, docs.staged_path])
    return STAGES[-1][1](spark, docs, sf_dir)
