"""Bars and observations stored in buckets by symbol, sorted by symbol and date: joins, windows and sums by symbol read them
as they lie, without a shuffle, and a symbol's rows are in one bucket's files."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.session import fresh_folder, remove_folder

BUCKETS = 64  #: tables that are joined need the same number; a bucket should fit a task


def write_bucketed(rows: DataFrame, name: str | None = None, buckets: int = BUCKETS, order: tuple[str, ...] = ("symbol", "trade_date")) -> str:
    """Stores ``rows`` as the catalog's table ``name``, or one of a new name, with its files in the shared folder; returns the name.

    Rows are dealt by symbol first, so that each bucket is one sorted file, which Spark can read in order."""
    spark = rows.sparkSession
    name = name or f"barloom_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "symbol")
    dealt.write.bucketBy(buckets, "symbol").sortBy(*order).format("parquet").mode("overwrite").option("path", fresh_folder(spark, name)).saveAsTable(name)
    return name


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Drops a stored table and its files."""
    path = next((r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Location"), None)
    spark.sql(f"DROP TABLE {name}")
    if path:
        remove_folder(spark, path)


@contextmanager
def as_it_lies(spark: SparkSession):
    """While this holds, plans may take rows that are dealt by symbol as dealt for joins by symbol and date, too, and use the
    buckets whatever the size of a table. Plans have to be made, and run, inside."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
