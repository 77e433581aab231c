"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartorio.llm import bpe, chat_format, lexical_search, license_scan, line_dedup, mixing, mpeg_audio, ngram_lm, quality_rules, spelling, url_filter, warc
from cartorio.llm.jaccard_join import jaccard_components
from cartorio.llm.shared import Scratch

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_components(table(spark, root, "documents"))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op2_byte_bpe")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return bpe.round_trip(table(spark, root, "documents"), TOKENIZER, public_tokenizers.PATTERN)


@query("op5_quality_rules", quality_rules.oracle_sql())
def op5(spark: SparkSession, root: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, root, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


@query("op8_mix_sources", mixing.ORACLE)
def op8(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, root, "documents").select("doc_id", "text", "source"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


@query("op9_chat_format", chat_format.ORACLE)
def op9(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return chat_format.digests(chat_format.format_windows(turns.unionByName(probe)))


@query("op10_warc")
def op10(spark: SparkSession, root: str) -> DataFrame:
    folder = Scratch(spark, "warc").root
    manifest = warc.write_archives(table(spark, root, "pages"), folder)
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query("op3_media_columns")
def op3(spark: SparkSession, root: str) -> DataFrame:
    media = Scratch(spark, "media").keep(mpeg_audio.media_of(table(spark, root, "documents")), "media")
    return mpeg_audio.features_of(media).drop("frame_offsets")


@query("op7_lm_scoring")
def op7(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", ngram_lm.held_out(F.col("doc_id")).alias("held_out"))
    model = ngram_lm.train(docs.filter("NOT held_out"), Scratch(spark, "lm").root)
    scored = ngram_lm.score_texts(docs, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op6_line_dedup", line_dedup.ORACLE)
def op6(spark: SparkSession, root: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, root, "documents").select("doc_id", "text")).drop("runs")


@query("op4_license_scan")
def op4(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return license_scan.by_document(docs, license_scan.scan_licenses(docs))


@query("op11_ranked_search", lexical_search.ORACLE)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return lexical_search.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op12_url_filters", url_filter.oracle_sql())
def op12(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, root, "pages"), url_filter.outcomes_of(table(spark, root, "labels")))


@query("op13_spelling_variants", spelling.ORACLE)
def op13(spark: SparkSession, root: str) -> DataFrame:
    return spelling.groups(table(spark, root, "documents"))
