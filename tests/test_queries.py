import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def catalogue():
    from catalogue.queries import CATALOGUE

    return list(CATALOGUE)


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", catalogue())
def test_query_equals_sql(spark, sql, name):
    import __spark_entry__ as entry
    from check import digest

    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in entry.oracle_sql():
        found = sql.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert digest(df.columns, rows)[0] == digest(columns, found.fetchall())[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
