"""How the plans read tables and register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files have fewer row groups than there are cores; such an input is small,
    and a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    """QUERIES, SQL and the decorator query(sql), which registers a function under its name."""
    queries: dict = {}
    sql: dict = {}

    def query(oracle: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = f
            if oracle is not None:
                sql[f.__name__] = oracle
            return f

        return keep

    return queries, sql, query
