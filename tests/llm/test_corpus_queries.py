import sys
from pathlib import Path as _P

sys.path.insert(0, str(_P(__file__).resolve().parent.parent))
from pathlib import Path

import pytest

import corpus_pipeline
from ledgerline.llm import queries as corpus
from oracle import differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the generated tables are not here")


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    rows, apart = differences(spark, corpus.queries()[name], corpus.oracle_sql()[name], SF)
    assert rows and not apart


@pytest.mark.parametrize("name", sorted(set(corpus.queries()) - set(corpus.oracle_sql())))
def test_query_without_sql_returns_its_rows(spark, name):
    assert corpus.queries()[name](spark, SF).count() > 0


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.persist()
        seen.append(docs.count())
    assert seen[0] <= before and seen[1] <= seen[0] and seen[2] <= seen[1]
    packed = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
