"""Session settings the flows are planned for."""

from __future__ import annotations

# Spark's defaults are kept but for the bloom filter that the tickets a selector
# keeps build for the scan of the actions.  Spark sizes it for four million ids at
# most; eight bits for each are 4 MiB, and with 64 bytes a row these ids are the
# 256 MB up to which a ticket side is scanned once more to build it.  A larger side
# would only fill the filter until it lets everything pass.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
}


def tuned(builder):
    """A session builder with the settings applied."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
