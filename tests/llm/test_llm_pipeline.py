"""The pipeline's stages against what each operator says of its input."""

import corpus_pipeline
from tallyspark.llm import mixing, queries, site_lines, templates

from llm_brute import brute_components


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id for r in queries.op9_quality(spark, small_dir).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.table(stage(spark, docs, small_dir), "test")
        assert docs.columns == names and docs.schema == before.schema
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            assert set(rows) == kept
        elif name == "line_dedup":
            assert {i: r.text for i, r in rows.items()} == {r.doc_id: r.text for r in site_lines.drop_site_lines(before).collect()}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert set(rows) == {i for i, _, c in groups if i == c}
        else:
            bad = {r.doc_id for r in templates.matches(before, spark.read.parquet(f"{small_dir}/benchmark.parquet")).collect()}
            assert set(rows) == {r.doc_id for r in before.collect()} - bad
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir)
    assert last.columns == [*names, "epoch", "block", "block_rank"]
    assert sorted(last.select("doc_id", "epoch", "block", "block_rank").collect()) == sorted(mixing.mix(docs).select("doc_id", "_epoch", "_block", "_rank").collect())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
