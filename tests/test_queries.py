"""Every registered query of the engine against its SQL, as the driver does it."""

import os

import duckdb
import pytest

from motifmill.plans import more, registry  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(rows):
    def value(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([value(v) for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    if name in registry.ORACLE_SQL:
        sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})")
        assert plain(rows) == plain(sql.fetchall())
    else:
        assert rows


@pytest.mark.parametrize("name", ["mh_pairs", "ratio_ranking"])
def test_a_report_has_its_whole_table(spark, name):
    """Beyond the rows of a report, every scored pair is in the query beside it, as the SQL has it."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    whole = {"mh_pairs": "mh_pairs_all", "ratio_ranking": "ratio_all"}[name]
    rows = [tuple(r) for r in registry.QUERIES[whole](spark, sf).collect()]
    report = [tuple(r) for r in registry.QUERIES[name](spark, sf).collect()]
    print(name, len(report), len(rows))
    assert len(rows) > len(report) and set(plain(report)) <= set(plain(rows))
    df = registry.QUERIES[whole](spark, sf)
    assert plain(rows) == plain(con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[whole]})").fetchall())
