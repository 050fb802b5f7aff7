"""The pipeline's stages against their operators' brute-force results."""

import duckdb
import pytest

import corpus_pipeline
from pagelake.llm import decontaminate, queries
from pagelake.plans.reuse import materialize
from tests.llm.test_dedup import brute_classes, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, results = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        results.append(docs)
    return results


def test_stages_keep_what_they_should(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    calm, exact, near, clean, packed = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids(docs) - ids(calm)) == 0
    groups = {}
    for r in calm.collect():
        groups.setdefault(sha(r.text), []).append(r.doc_id)
    assert ids(exact) == {max(g) for g in groups.values()} and exact.count() == len(groups)
    assert ids(near) == set(brute_classes(exact).values())
    leaky = {r.doc_id for r in decontaminate.contamination(near, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert ids(clean) == ids(near) - leaky and leaky
    assert ids(packed) == ids(clean)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_sql_of_queries(spark):
    base = duckdb.connect()
    for name in ("documents", "pages"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    for name, sql in queries.ORACLES.items():
        result = base.execute(sql)
        columns = [c[0] for c in result.description]
        want = sorted(map(repr, result.fetchall()))
        assert sorted(repr(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == want
