"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import data_queries, evaluation_queries, io_queries, metric_queries, model_queries, series_queries
from tidewatch.plans.roles import Query

CATALOG: list[Query] = [
    *series_queries.QUERIES, *metric_queries.QUERIES, *evaluation_queries.QUERIES, *data_queries.QUERIES, *io_queries.QUERIES, *model_queries.QUERIES,
]


def prepare(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times are plain UTC
        return query.build(spark, sf_dir)

    return run
