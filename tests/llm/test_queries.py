import pytest

from treeweft.llm.queries import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{TABLES}/{table}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, TABLES).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, TABLES)
        assert docs.columns == columns, name
    found = p.run(spark, TABLES).collect()
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 2048 for v in by.values()) and 0 < len({r["doc_id"] for r in found}) < rows
