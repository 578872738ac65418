"""Case ids have six digits: beyond a million orders several packets share one."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    path = tmp_path_factory.mktemp("shared")
    duckdb.sql(f"COPY (SELECT unnest([i, 1000000 + i * 3, 2000000 + i]) AS o_orderkey, i * 7 % 101 AS o_custkey FROM range(400) t(i) ORDER BY 1) TO '{path}/orders.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["coverage", "manual_corrections", "name_selection", "stream_fusion", "fused_evidence"])
def test_packets_stay_apart(spark, shared, name):
    with duckdb.connect() as con:
        con.execute("SET threads = 1")  # arg_min takes the first of equals, in file order
        con.execute(f"CREATE VIEW orders AS FROM '{shared}/orders.parquet'")
        want = sorted(map(str, con.execute(entry.oracle_sql()[name]).fetchall()))
    got = sorted(str(tuple(r)) for r in entry.queries()[name](spark, shared).collect())
    assert got == want


def test_one_row_per_packet(spark, shared):
    assert entry.queries()["packet_pipeline"](spark, shared).count() == 1200
