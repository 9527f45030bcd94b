"""Every quick query against its SQL, on the smallest data."""

import decimal

import duckdb
import pytest

from factloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = {"evidence_relations", "propagated_beliefs", "conflict_outcomes", "claim_answers"}
SLOW = {n for n, q in catalog.QUERIES.items() if q.__module__.endswith("catalog_graph")} - GRAPH - {"text_duplicates", "latest_supersession"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)) and not isinstance(value, bool):
        return round(float(value), 8) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_statement_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
