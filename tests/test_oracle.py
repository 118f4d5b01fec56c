"""Every core query with SQL, against DuckDB over the same tables (sf0.001)."""

import math

import duckdb
import pytest

from cohortspark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Iterative plans: minutes of rounds for all of them, so they run at one size only elsewhere.
SLOW = {"X4_seaways_table", "D26_counts_after_three_steps", "N7a_lines_of_survivors"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    if isinstance(a, (tuple, list)) and isinstance(b, (tuple, list)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(map(same, got, want))
