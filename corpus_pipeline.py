"""The corpus pipeline: documents to a weighted training mix in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``; the last adds the epoch, block and rank
in which the mix reads each document (with a trailing underscore where the
documents have such a column).  Extra columns pass through all stages.

SQL cannot express the learned first stage, so ``ORACLE_SQL`` is None; the
tests compare the pipeline with brute-force versions of its stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import mixing, ngram_join, quality_gam, site_lines, templates
from tallyspark.llm.common import free, table


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (score of 0.5 or more)."""
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_gam.with_score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(*_own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows."""
    out = site_lines.drop_site_lines(docs).select(*_own(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The temperature mix of the sources, a row for each reading of a document."""
    out = mixing.mix(docs)
    places = zip(out.columns[-3:], ("epoch", "block", "block_rank"))
    return out.select(*_own(docs), *[F.col(c).alias(free(docs, name)) for c, name in places])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each from the files of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
