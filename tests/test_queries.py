"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from casewise.plans.catalogue import CATALOGUE

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["demographic_cohort", "case_dataset", "global_signal_summary", "signal_stratified", "feature_disprop", "age_trend_tests", "report_missingness", "roc_auc"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    query, sql = CATALOGUE[name]
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_entry_module_lists_queries():
    import __spark_entry__ as entry

    assert set(CATALOGUE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_relations_read_the_order_tables_once(spark):
    from casewise.plans.catalogue import Periods, Relations, _kept_frame

    r, p = Relations(spark, FOLDER), Periods(spark, FOLDER)
    for df in (r.signals, r.dataset, p.signals, p.features, _kept_frame(r)):
        assert not [f for f in df.inputFiles() if f.endswith("/lineitem.parquet") or f.endswith("/part.parquet")]
    # of a case's quarters, only the one in the index has children
    assert p.quarterly.drugs.count() <= p.index.count() == p.signals.count()
