"""Every registered query runs on the smallest tables and equals its DuckDB oracle."""

import pytest

import __spark_entry__ as E
from ragloom.plans import catalog
from tests.conftest import SF_SMOKE
from tests.oracle import duck, rows

catalog.load_all()
QUERIES, ORACLE = dict(catalog.QUERIES), dict(catalog.ORACLE)


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) >= 0
    assert df.columns == E.entry(spark).columns


def test_entry_module_registers_the_catalogue():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_every_query_has_an_oracle_or_is_documented_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"v8_project_vectors", "u1_embed_text", "v6_ivf_search", "x2_rag_from_text",
                         "st4_dedup_within_ttl", "s6_list_files", "v6_ivf_search_stored"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMOKE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMOKE).toPandas()
    if name not in ORACLE:
        assert len(sdf.columns) > 0
        return
    ddf = con.execute(ORACLE[name]).df()
    sc, sr = rows(sdf)
    dc, dr = rows(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
