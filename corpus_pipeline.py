"""From raw documents to packed sequences: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the columns of
documents: the first drops documents to which no language can be given, the second deletes later repeated runs of lines
(and documents of which nothing is left), the third keeps one document of each near-duplicate component, the fourth drops
contaminated ones. The last returns the pieces of the packed sequences. Further columns may have any names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, lines, neardup, packing
from millrace.llm.common import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which a language can be given. Null and empty texts and those without a letter go; ties between languages, repeated
    rows and null ids stay; an empty table gives one. Texts of any length are parsed whole."""
    return langid.in_known_language(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of three lines or more; one of which nothing is left goes. Null and empty texts stay; rows
    equal in id and text are one document; a null id comes first; an empty table gives one."""
    return lines.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component. Texts without words stay, null and empty ones too; so do rows with a null
    id; rows of one id are one document and go or stay together; an empty table gives one."""
    return neardup.representatives(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, row by row, whatever their ids. Null and empty texts stay, repeated rows go or stay together;
    an empty table of documents gives one, and one of items takes nothing away."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Null and empty texts have their end id alone; repeated rows are packed once each; an empty
    table gives no piece. Other columns are not read."""
    return packing.pack(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("packed", packed)]

#: Language identification and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
