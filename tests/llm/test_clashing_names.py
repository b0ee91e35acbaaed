"""Inputs that already have every column name which the operators use inside."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing, ngram_join, quality_gam, site_lines, surrogates, templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "Plain words that make up a text\nof two lines, number {}\nshared line of the host"
ROWS = [(i, TEXT.format(i), "en", f"s{i % 2}", 1) for i in range(30)] + [(None, "Mail jane.doe@mail.org now", "en", None, 2), (31, None, None, "s0", None)]


def names_inside():
    """Every name in quotes in the operators' modules that could be a column."""
    found = set()
    for module in (mixing, ngram_join, quality_gam, site_lines, surrogates, templates):
        found |= set(re.findall(r"""["'](_?[a-z][a-z_0-9]{0,12})["']""", open(module.__file__).read()))
    return sorted(found - set(DOCS.replace(",", "").split()))


@pytest.fixture(scope="module")
def docs(spark):
    own = names_inside()
    assert {"_words", "_bad", "_row", "turns", "host", "kept", "_copies", "h", "block"} <= set(own)
    return spark.createDataFrame(ROWS, DOCS).select("*", *[F.lit(f"my {c}").alias(c) for c in own])


def untouched(before, after, added):
    assert after.columns[:len(before.columns)] == before.columns and len(after.columns) == len(before.columns) + added
    own = [c for c in before.columns if c not in DOCS.replace(",", "").split()]
    rows = after.select(*[F.min(F.col(f"`{c}`") == f"my {c}").alias(c) for c in own]).first()
    assert all(rows)
    return after


def test_operators_keep_the_input_columns(spark, docs):
    assert untouched(docs, mixing.mix(docs), 4).count() >= 30
    out = untouched(docs, site_lines.drop_site_lines(docs), 2)
    assert out.where("text like '%shared%'").count() == 0 and out.columns[-2:] == ["_lines", "_dropped"] or out.columns[-2:] == ["_lines_", "_dropped_"]
    assert untouched(docs, quality_gam.with_score(docs, quality_gam.Model(0.0)), 1).count() == len(ROWS)
    out = untouched(docs, surrogates.pseudonymise(docs), 1)
    assert out.where("text like '%jane.doe%'").count() == 0 and out.count() == len(ROWS)
    bench = spark.createDataFrame([(1, ROWS[3][1])], "item_id long, text string")
    assert untouched(docs, templates.drop_contaminated(docs, bench), 0).count() < len(ROWS)
    assert untouched(docs, ngram_join.keep_one(docs), 0).count() >= 1


def test_stages_keep_the_input_columns(spark, docs, small_dir):
    import corpus_pipeline

    more = docs.withColumn("epoch", F.lit("my epoch")).withColumn("block_rank", F.lit("my block_rank"))
    for name, stage in corpus_pipeline.STAGES:
        out = untouched(more, stage(spark, more, small_dir), 3 if name == "mix" else 0)
        assert len(set(out.columns)) == len(out.columns)
