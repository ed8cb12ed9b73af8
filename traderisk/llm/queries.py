"""The thin ``opN_`` queries over the given tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traderisk.llm import (chat_format, decontamination, importance, language_id, lexical_search, mixing, near_dedup, packing, quality_rules,
                           token_counts, token_files, toxicity, url_filter)
from traderisk.llm.common import read


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: two-word shingles, Jaccard similarity of at least 80 %."""
    rows = near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked into the documents."""
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and model verdicts on the urls of all pages."""
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents with a perfect hash index, read back."""
    return token_files.token_files(read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings, formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.formatted_digests(rows)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: rules on each text, line frequency across a host's texts."""
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), 2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by whole-token shortcut."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), limit=4096)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by nearest centroid."""
    return language_id.languages(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents by class-conditional Kneser-Ney models."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=50)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1, none above two epochs."""
    rows = mixing.mixture(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words and word pairs."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_token_files": op4_token_files,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_mixing": op12_source_mixing,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op6_quality_rules": quality_rules.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_source_mixing": mixing.SQL,
    "op13_importance_resampling": importance.SQL,
}
