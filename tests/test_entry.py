"""The driver's contract: every query runs, and every SQL gives its rows (sf0.001 here)."""

import os
import time

import duckdb
import pytest

import __spark_entry__ as contract

DATA = os.environ.get("AEROFRAME_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return made


def shown(frame):
    cell = lambda v: "-" if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


from aeroframe.plans import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, db, name):
    got = contract.queries()[name](spark, DATA).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    assert shown(got) == shown(db.execute(sql).fetchdf())


@pytest.mark.parametrize("name", ["load_cpc_focused", "load_fmps_english"])
def test_a_file_for_each_day_whatever_the_partitions(spark, db, name):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "12"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = contract.queries()[name](spark, DATA).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert shown(got) == shown(db.execute(contract.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", ["load_cpc_focused", "load_fmps_english"])
def test_days_whose_places_reach_into_the_next_keep_all_rows(spark, tmp_path, name):
    made = duckdb.connect()
    made.execute("create table events as select i as event_id, timestamp '2024-01-01' + to_seconds(i // 2) + case when i < 87000 then interval 0 day else interval 1 day end as ts, i % 5 as user_id, 'view' as event_type, (i % 700) / 4 as value, '{}' as props from range(87100) t(i)")
    made.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = contract.queries()[name](spark, f"file://{tmp_path}").toPandas()
    assert len(got) == 87100 and got.ts.duplicated().any()
    assert shown(got) == shown(made.execute(contract.oracle_sql()[name]).fetchdf())


def test_union_of_other_bins_is_planned_soon(spark):
    made = contract.queries()["folder_union_other_bins"](spark, DATA)
    began = time.time()
    made._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 15


def test_flagship(spark):
    assert contract.entry(spark).count() >= 1


def test_seconds_of_the_whole_table(spark, db):
    got = contract.queries()["rebin_1s_count"](spark, DATA).selectExpr("sum(total_conc)", "count(*)", "min(ts)", "max(ts)").first()
    n, first, last = db.execute("select count(*), date_trunc('second', min(ts)), date_trunc('second', max(ts)) from events").fetchone()
    assert tuple(got) == (n, (last - first).total_seconds() + 1, first, last)
