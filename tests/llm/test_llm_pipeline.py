"""The pipeline: each stage by itself, all together, and the registration."""

import corpus_pipeline
import pytest
from conftest import SF
from test_llm_simhash import plain_groups
from text_cases import odd_documents, table

import __spark_entry__ as entry
from kolekta.llm import decontaminate, quality, queries, simhash, toxicity


def test_registration():
    assert set(queries.QUERIES) <= set(entry.queries()) and entry.queries()["pipeline"] is corpus_pipeline.run
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_run_equals_the_decisions_of_its_operators(spark):
    docs = table(spark, SF, "documents").cache()
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    kept = docs.join(quality.judge(docs, labels).where("keep").select("doc_id"), "doc_id", "left_semi")
    civil = toxicity.with_score(kept, toxicity.train(kept, labels)).where(f"score < {toxicity.THRESHOLD}")
    rows = [(r.doc_id, r.text) for r in civil.select("doc_id", "text").collect()]
    firsts = {c for _, _, c in plain_groups(rows)}
    dirty = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(firsts - dirty)
    texts = dict(rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) == len(r.begins) for r in got) and set(texts) >= {r.doc_id for r in got}
    docs.unpersist()


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_each_stage_on_odd_rows(spark, at):
    docs = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, SF)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.schema.simpleString() == docs.schema.simpleString()
    assert 0 < out.count() <= 12
    assert stage(spark, docs.limit(0), SF).count() == 0
