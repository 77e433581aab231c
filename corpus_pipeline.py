"""Corpus pipeline: quality rules, line dedup, near duplicates, source mix, tokens.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of
``documents``; the last one returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartorio.llm import bpe
from cartorio.llm.jaccard_join import jaccard_components
from cartorio.llm.line_dedup import dedup_lines
from cartorio.llm.mixing import mix_documents
from cartorio.llm.quality_rules import judge
from cartorio.llm.shared import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the threshold table accept."""
    return judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a document of which no line is left goes. n_chars follows the text."""
    left = dedup_lines(docs.select(*COLUMNS)).filter("n_deleted = 0 OR n_deleted < n_lines")
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id.

    Of equal rows one stays; an id that stands on different texts keeps one row of each. Rows without an id stay.
    """
    first = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    # The rows of an id are together after the join, so leaving out repeats needs no further exchange.
    named = docs.select(*COLUMNS).filter("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mix_documents(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and whether decoding them gives the text back."""
    encoded = bpe.encode_texts(docs.select(*COLUMNS), TOKENIZER, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "text"))
    decoded = bpe.decode_ids(encoded, TOKENIZER, public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", whole.alias("lossless"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

#: The token stage is beyond SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; rows of the last one."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
