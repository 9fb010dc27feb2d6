"""Queries of this subpackage for ``__spark_entry__``: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import collocations, decontamination, embedding_dedup, html_extraction, line_dedup, mixing, ngram_join, oracle, periodic_runs, quality, suffix_dedup, token_counts, toxic_spans, warc
from tallystone.llm import pipeline as stages
from tallystone.llm._shared import Scratch, source


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's documents share."""
    found = line_dedup.drop_boilerplate(spark, source(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "text", F.col(line_dedup.LINES).alias("n_lines"), F.col(line_dedup.DROPPED).alias("n_dropped"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a content-addressed archive and read back from it."""
    folder = Scratch(spark, "warc").root
    warc.write(source(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3, repeating, takes of each document."""
    found = mixing.mix(spark, source(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of each document, from ratings of some, and whether it is good enough to keep."""
    found = quality.score(spark, source(spark, sf_dir, "documents"), quality.ratings_of(source(spark, sf_dir, "labels")))
    return found.select("doc_id", "__tallystone_quality.*")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a cosine of 0.93 or more between embeddings of one label, and their components."""
    return embedding_dedup.near_duplicates(spark, source(spark, sf_dir, "embeddings"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items."""
    found = decontamination.contamination(spark, source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more, counted, and their components."""
    found = ngram_join.join(spark, source(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in two documents."""
    return suffix_dedup.passages(spark, source(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page, by its host's wrapper."""
    return html_extraction.main_text(spark, source(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and longest-match tokens of each document, by a public vocabulary."""
    return token_counts.count_tokens(spark, source(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a model of toxic words, learnt from two thirds of the labels."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs, labels = source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels")
    found = toxic_spans.score(spark, docs, labels.where(~held_out))
    score = F.col(toxic_spans.FOUND)["score"]
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= toxic_spans.TOXIC).cast("int").alias("predicted"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of each language, 2000 at most."""
    return collocations.mine(spark, source(spark, sf_dir, "documents"))


def _with_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by the id's checksum, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.nullif(F.size("w"), F.lit(0))).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(F.transform(places, lambda i: F.get("w", i)), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document's words, the strongest one, and digests of all runs and of the text without repeats."""
    found = periodic_runs.periodic_runs(_with_period(source(spark, sf_dir, "documents"))).select("doc_id", f"{periodic_runs.FOUND}.*")
    best = F.get("runs", "strongest")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_source_mixing, op4_quality_classifier, op5_embedding_near_dedup, op6_benchmark_decontamination, op7_ngram_jaccard_join, op8_suffix_array_dedup, op9_html_extraction, op10_token_counts, op11_toxicity, op12_phrase_collocations, op13_periodic_runs, pipeline)}
ORACLE_SQL = oracle.ORACLE_SQL
