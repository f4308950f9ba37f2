"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(values, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = []
    for v in values:
        out.append(tuple(round(x, 9) if isinstance(x, float) else x for x in (v[i] for i in order)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        from tracklake import catalog

        metafunc.parametrize("name", sorted(catalog.ORACLE_SQL))


def test_matches_sql(spark, duck, name):
    from tracklake import catalog

    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def by_few_values(df):
    """Joins whose rows are dealt out and sorted by a key that a genome has few values of."""
    return re.findall(r"SortMergeJoin \[(?:chrom|track)#\d+\]", df._jdf.queryExecution().executedPlan().toString())


#: Queries on depth that no other test of plans names.
DEPTH = ["denovo_windows", "first_track", "matrix_resample", "multitrack_mean_pivot", "auto_dict_bits", "bedgraph_sink", "dict_cost_curve", "enumerate_values", "hist_global", "hist_mean_std", "hist_region_below_above", "islands_high", "islands_high_mean"]


@pytest.mark.parametrize("query", DEPTH)
def test_reads_are_not_joined_by_chromosome(spark, monkeypatch, query):
    """A chromosome's rows would all be sorted in one task."""
    from tracklake import catalog
    from tracklake.sources import text

    plans, write = [], text.write_bedgraph
    monkeypatch.setattr(text, "write_bedgraph", lambda runs, *a, **k: (plans.append(runs), write(runs, *a, **k)))
    plans.append(catalog.QUERIES[query](spark, SF))
    assert not [j for df in plans for j in by_few_values(df)]
