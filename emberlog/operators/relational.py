"""Statements with joins, groups, order, common tables: Spark's own semantics, planned by Catalyst."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sql import syntax as s
from ..sql.errors import UnsupportedFeature
from ..sql.render import SparkRenderer


def select_relations(q: s.Select, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a statement over named tables (names in any case)."""
    if not tables:
        raise UnsupportedFeature("a statement over no tables", q.span)
    spark = next(iter(tables.values())).sparkSession
    views = {}
    for name, df in tables.items():
        views[name.lower()] = view = f"emberlog_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
    try:
        return spark.sql(SparkRenderer(views).select(q))
    finally:  # the statement is analysed by now
        for view in views.values():
            spark.catalog.dropTempView(view)
