"""From raw documents to a training mix: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last says for each document
that is left how many words the mix takes of it. Between stages the documents are Parquet in the shared folder, so a
lost executor or a failed stage costs that stage at most.

Null and empty texts, repeated rows, null ids and further columns are as each stage's operator has them; an empty table
gives an empty mix. Without ratings the classifier keeps all, without items the decontamination does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import decontamination, line_dedup, mixing, ngram_join, quality
from tallystone.llm._shared import Scratch, source


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that an ordinal classifier, fitted on the rated ones, takes for neither toxic nor of low quality."""
    return quality.select(spark, docs, source(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents of their source share; ``n_chars`` follows the text."""
    found = line_dedup.drop_boilerplate(spark, docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 or more hold together."""
    return ngram_join.one_of_each(spark, docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontamination.clean(spark, docs, source(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document."""
    return mixing.mix(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: A fitted classifier has no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = source(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
