"""From raw documents to a training mix: each stage reads what the one before it kept.

Language identification drops documents without a sure language; SimHash keeps one document of each group of near
duplicates; substring dedup cuts passages that an earlier document has; decontamination drops documents that hold
benchmark passages; mixing measures what is left and says how many words of each document the mix takes.

Every stage takes an empty table (and returns one), repeated rows, ids that repeat or are null, texts that are null,
empty or very long, and further columns of any name, which it keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontam, langid, mixing, simhash, substring_dedup
from textmill.llm.common import discard, free_name, keyed, written


#: Only documents in about even halves of two languages go: the part of the usual gap that op8 flags is four times this.
EVEN_HALVES = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, and that aren't of two languages alike. Null texts and texts without a letter have none, so they go; so does all if no document has a label to learn from. Repeated rows are decided alike."""
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model, ambiguous=EVEN_HALVES)
    language, _, ambiguous = found.columns[-3:]
    return found.filter((F.col(language) != langid.UNKNOWN) & ~F.col(ambiguous)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates; of equal ids the one of the least text, null ids last. Null texts and texts without a word all stay."""
    return simhash.one_of_each(docs)


def substring_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that stand earlier in the corpus, and n_chars as it is then. Null stays null; a document that loses all words is empty, and stays."""
    kept = substring_dedup.dedup_passages(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none and stay."""
    marked = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = marked.columns[len(docs.columns) + 1]
    return marked.filter(F.col(hit) == 0).select(*docs.columns)


MEASURES = ("size", "source_size", "target", "taken")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, their source's size and target, and the words that the mix takes of them (names in use are lengthened). Null texts have size 0; a null source is a source."""
    rows, key = keyed(docs, "doc_id", "text", free_name(docs, "_key"))
    mixed, _, _ = mixing.mix(rows.select(F.col(key).alias("id"), "source", "text"), "id")
    other = free_name(rows, "_id")
    names = [free_name(docs, m) for m in MEASURES]
    measures = mixed.select(F.col("id").alias(other), *(F.col(m).alias(n) for m, n in zip(MEASURES, names, strict=True)))
    return rows.join(measures, F.col(key) == F.col(other)).select(*docs.columns, *names)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup_),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Near duplicates by SimHash and the learned language model can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written before the next reads it, and removed when that has."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
