"""Dimension joins.

Only dimensions whose size is fixed by their domain are hinted.  For sides that grow
with the data the join is left to Catalyst and AQE, which compare measured sizes with
``spark.sql.autoBroadcastJoinThreshold``; no job runs while a query is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_dim(df: DataFrame) -> DataFrame:
    """Broadcast a dimension whose size is fixed by its domain (the 25 nations and 5
    regions, the 5 cluster labels), independent of data volume."""
    return F.broadcast(df)
