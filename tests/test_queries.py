import pytest
from oracle import compare

from treeloom.functions import units
from treeloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_format_bytes_past_a_long(spark, tmp_path):
    keys = [0, 7, 2999, 499277, 499278, 499280, 499289, 899999, 8999999, 2**32 + 1, 5 * 10**11]
    spark.createDataFrame([(k,) for k in [*keys, None]], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    whole = {k: k * k * 37 * 1000 ** (k % 3) - 10**9 * (k % 7 == 0) for k in keys}
    want = {(k, n if n < 2**63 else None, units.format_bytes(n), units.format_percent(k % 100, k % 150)) for k, n in whole.items()}
    got = QUERIES["format_bytes"](spark, str(tmp_path))
    assert got.schema["n"].dataType.simpleString() == "bigint"
    assert {tuple(r) for r in got.collect()} == want | {(None, None, None, None)}
    assert sum(n >= 2**63 for n in whole.values()) > 3
