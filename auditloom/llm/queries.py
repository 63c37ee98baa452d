"""One query per operator over its whole table, and the same in SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import alignment, cover_tree, decontaminate, extract, language, lexical, licenses, mixing, near_dups, ngram_lm, repetition, substrings, token_counts
from auditloom.llm.store import bound_batches

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.train_languages(docs.where(~out & F.col("doc_id").isNotNull()))
    return language.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "language.lang_pred", "language.score"
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bound_batches(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_documents(spark, sf_dir))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return repetition.with_repetition(docs).select(
        "doc_id",
        *[f"repetition.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "n_repeat_spans")],
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = substrings.with_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select("doc_id", substrings.removal_digest(F.col("text"), F.col("repeats")).alias("d")).select("doc_id", "d.*")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(_documents(spark, sf_dir), language.held_out(F.col("doc_id"), 5, 1))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicate_classes(_documents(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir)).per_document()


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(bound_batches(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language, op2_main_text, op3_token_counts, op4_mix, op5_decontaminate, op6_licenses, op7_repetition, op8_substrings, op9_lm_scores, op10_near_duplicates, op11_search, op12_alignment, op13_near_vectors)
}
CHECKS = {
    "op4_mix": mixing.MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM counted",
    "op11_search": lexical.SEARCH_SQL,
    "op13_near_vectors": cover_tree.NEAR_SQL,
}
