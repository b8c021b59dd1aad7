import corpus_pipeline as P

from covergraph.llm import queries
from covergraph.llm._common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == first.columns and docs.select("doc_id").distinct().count() == docs.count()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    assert all(labels.get(r.doc_id) != 0 for r in docs.collect() if len(r.text) > 2000)
    mixed = P.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == sizes[-1]
    # Nothing of the benchmark is left, and no passage occurs twice.
    found = queries.decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sum(len(r.starts) > 0 for r in found.collect()) <= 1


def test_stages_take_odd_rows(spark, odd):
    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count()
        if (name, stage) != P.STAGES[-1]:
            assert sorted(out.columns) == sorted(odd.columns)


def test_stages_take_empty_tables(spark, plain):
    docs = spark.createDataFrame([], plain)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
