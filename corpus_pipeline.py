"""The document pipeline: each stage works on what the one before it kept.

Defined results, from those that the operators of sparkwright.llm state: a document with a null or empty text fails the quality rules,
so no later stage gets one from run(), but each stage takes one by itself. A null id, language or source is carried; rows that repeat are
judged alike, and near_duplicates keeps one of them. Of near duplicates the smallest id stays, ids before null. Very long texts go
through whole, and an empty table gives an empty result. Further columns are kept, whatever their names. All stages but
the last return the columns of their input; the last one adds how often a document is taken and how many words
that makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from sparkwright.llm.common import materialize, table


#: Whole texts are long: so many rows of an Arrow batch, at most, keep a task's buffers small.
ARROW_ROWS = 1000


def _batched(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, after the session's Arrow batches were made as small as ARROW_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    return docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the quality rules reject."""
    return quality_rules.keep_good(_batched(spark, docs))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the lines that three or more documents share out of all but one holder."""
    return line_dedup.apply_line_dedup(_batched(spark, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Fingerprints within 3 bits and bands of minima give the candidates only; each link is verified on the whole sets of shingles.
    """
    return simhash.one_of_similar(_batched(spark, docs), width=5, similarity=0.8, radius=3)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that a benchmark item contaminates."""
    return decontamination.decontaminate(_batched(spark, docs), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix of sources takes, with its number of copies and of words."""
    return mixing.apply_mix(_batched(spark, docs))


STAGES = [
    ("quality_rules", quality), ("line_dedup", shared_lines), ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages), ("mixing", mix_sources),
]

#: The tokeniser, the fingerprint links and the tiling are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; what a stage keeps is written, so a later one does not compute it again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
