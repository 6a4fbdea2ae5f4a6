"""Session settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates are cut from timestamps in this zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the next step needs the join's partitioning: the extra
    # shuffle is added only when a skewed partition was seen.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Drop activities of closed processes before they are shuffled, however large the table
    # of open ones is. The filter itself has a fixed size (8 MB at most).
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "40000000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply `SETTINGS`. Sizes (shuffle partitions, memory) stay the cluster's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
