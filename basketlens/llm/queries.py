"""Queries over the thirteen operators and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from basketlens.llm.decontamination import contaminated
from basketlens.llm.extraction import extract
from basketlens.llm.filter_audit import audit
from basketlens.llm.lexical_search import lexical_search
from basketlens.llm.mixing import schedule
from basketlens.llm.ngram_join import jaccard_components
from basketlens.llm.oracle import FILTER_AUDIT, LEXICAL_SEARCH, URL_FILTER
from basketlens.llm.quality import quality
from basketlens.llm.secrets import secrets
from basketlens.llm.surrogates import surrogates
from basketlens.llm.tables import read
from basketlens.llm.token_counts import token_counts
from basketlens.llm.token_output import token_output
from basketlens.llm.toxicity import toxicity
from basketlens.llm.url_filter import url_filter
from basketlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(tune(spark), sf_dir, "documents")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_documents(spark, sf_dir))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(_documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(tune(spark), sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_documents(spark, sf_dir))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, read(tune(spark), sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(spark, _documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(tune(spark), sf_dir)


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_output, op2_mixing_sources, op3_html_extraction, op4_secret_scan, op5_pii_surrogates, op6_toxicity,
        op7_quality_rules, op8_ngram_jaccard_join, op9_benchmark_decontamination, op10_token_counts, op11_url_filter,
        op12_lexical_search, op13_filter_audit, pipeline,
    )
}

# The others cannot be written as SQL that is quick on whole tables; tests hold each against brute force.
LLM_ORACLE: dict[str, str] = {
    "op11_url_filter": URL_FILTER,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_filter_audit": FILTER_AUDIT,
}
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
