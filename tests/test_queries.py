import duckdb
import pytest

from tallyforge import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 9)
    return str(value) if not isinstance(value, (int, bool)) else int(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_its_sql(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    found = oracle.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == rows


def test_plans_read_only_what_they_need(spark):
    plan = registry.queries()["monthly_spending"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReadSchema: struct<l_linenumber:int,l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    plan = registry.queries()["tx_date_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), IsNotNull(l_shipdate)" in plan
