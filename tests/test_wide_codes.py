"""Queries on suppliers whose codes have more than four digits, as larger tables have them, against their SQL."""

import duckdb
import pytest
from barloom.plans import oracles, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """The smallest tables with suppliers 9995 to 10004."""
    path = str(tmp_path_factory.mktemp("wide"))
    for name, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.withColumn(key, F.col(key) + 9995).write.parquet(f"{path}/{name}.parquet")
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{path}/nation.parquet")
    return path


@pytest.mark.parametrize("name", ["common_names", "listings", "month_bars", "month_rejects"])
def test_codes_of_five_digits(spark, wide, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{wide}/{t}.parquet/*.parquet'")
    cursor = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    told = lambda rows: sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] for v in r) for r in rows), key=repr)
    want = told(cursor.fetchall())
    assert want and told(queries.queries()[name](spark, wide).select(columns).collect()) == want
