import duckdb
import pytest

from peerskill.llm import queries as Q
from tools.check_oracle import TABLES, frame_hash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame_hash(got)[0] == frame_hash(want)[0]


def test_pipeline(spark):
    import corpus_pipeline as C
    from peerskill.llm.common import table, written

    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SF), "t")
        assert docs.columns == C.COLUMNS
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
        if name == "near_dedup":
            assert docs.count() == docs.select("text").distinct().count()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2
    out = C.STAGES[-1][1](spark, docs, SF)
    assert out.count() == sizes[-1] and out.where("not round_trip").count() == 0
