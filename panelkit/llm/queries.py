"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm.common import read_table
from panelkit.llm.exact_dedup import exact_dedup
from panelkit.llm.langid import language_id
from panelkit.llm.lexical import SQL as SEARCH_SQL
from panelkit.llm.lexical import search
from panelkit.llm.lines import SQL as LINE_SQL
from panelkit.llm.lines import line_dedup
from panelkit.llm.merkle import fingerprint_edits
from panelkit.llm.mixing import mix
from panelkit.llm.pii import find_pii
from panelkit.llm.quality import quality_scores
from panelkit.llm.registry import register
from panelkit.llm.sentencepiece_trie import encode_documents
from panelkit.llm.simhash import near_dedup
from panelkit.llm.substring import substring_dedup
from panelkit.llm.suffix_dedup import suffix_dedup
from panelkit.llm.token_align import alignment_links


@register("op2_exact_dedup", """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


@register("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@register("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


@register("op7_line_dedup", LINE_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "pages"))


@register("op8_merkle_fingerprints")
def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


@register("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


@register("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


@register("op12_lexical_search", SEARCH_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_links(read_table(spark, sf_dir, "documents"))
