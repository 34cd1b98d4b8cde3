"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from corpusloom.plans import catalog, datasets, labelling, serving  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    expected = sorted([plain(r[names.index(c)]) for c in columns] for r in want.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    again = catalog.QUERIES[name](spark, sf).collect()
    assert sorted(map(plain, rows)) == sorted(map(plain, again))
