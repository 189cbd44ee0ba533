"""Driver queries of this subpackage: thin layers over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from respanel.llm import chat, decontaminate, htmltext, linededup, packing, quality, ranked, rulefit, sentences, simhash, tokencount, vectorcodes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return out.select("doc_id", F.col("__removed").alias("n_removed_lines"), "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes = chat.tree(rows.unionByName(extra), "conv_id", ["turn", "role", "text"])
    nodes = nodes.select(F.col("conv_id").alias("conv"), "node", "parent", F.length("text").alias("score"), "role", "text")
    return chat.read_back(chat.format_trees(nodes))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentences.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__sentences").alias("n_sentences"), F.col("__removed").alias("n_removed"), "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", F.round("good", 6).alias("good")
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rulefit.score(docs, rulefit.train(docs, table(spark, sf_dir, "labels")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every embedding."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_zip_warc": op2_zip_warc,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_html_extraction": op10_html_extraction,
        "op11_token_counts": op11_token_counts,
        "op12_ranked_search": op12_ranked_search,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    own = {"op12_ranked_search": ranked.ORACLE_SQL, "op13_vector_codes": vectorcodes.oracle_sql()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
