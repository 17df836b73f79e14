import __spark_entry__ as entry
import pytest
from treeweft.plans.queries import ORACLE, QUERIES

TABLES = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "mae", "cosine_similarity"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{TABLES}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    found = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, rows))
