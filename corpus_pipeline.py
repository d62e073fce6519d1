"""The pipeline over documents: toxicity, near copies, benchmark leaks, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a frame; run() writes each stage's frame as
Parquet in the shared folder, reads it back as the next one's docs, and deletes what the stage before wrote.

Null and empty texts are documents without words: they score by the classifier's intercept, are nobody's copy, hold no benchmark
item, take their place in the mixture and are an end id alone. Rows with a null id stay through all stages and come first of their
source; rows that repeat an id are kept or dropped by their own texts, but go together as copies. Ties are settled by the smaller
id. An empty table passes through as one. All other columns are passed on untouched, whatever their names, but by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.decontamination import keep_clean
from basketlens.llm.mixing import mixed
from basketlens.llm.ngram_join import keep_one
from basketlens.llm.tables import forget, prepared, read, written
from basketlens.llm.token_output import token_output_in_file_order
from basketlens.llm.toxicity import keep_civil
from basketlens.session import tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the fitted classifier rejects go."""
    return keep_civil(docs, read(tune(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more) the smallest id stays."""
    prepared(tune(spark))
    return keep_one(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep_clean(docs, read(tune(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the rows lie in it in the files written."""
    prepared(tune(spark))
    return mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents as shards, in the order of the mixture; digests read back from them."""
    prepared(tune(spark))
    return token_output_in_file_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing_sources", mix_sources),
    ("token_output", write_tokens),
]

# The fitted classifier and the tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    # The last stage has written its files when it returns; its rows are read from these.
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)
    return out
