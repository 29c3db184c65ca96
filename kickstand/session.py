"""Spark session settings used by the bench and the tests."""

from pyspark.sql import SparkSession


def build_session(master=None, app="kickstand", shuffle_partitions=None, **conf):
    """Session with the settings the jobs rely on; a cluster's own settings win where given.

    Times are naive (`timestamp_ntz`), so the zone only matters for parsing text times: it is pinned
    to UTC. AQE sizes shuffle partitions, splits skewed join partitions and turns a join into a
    broadcast when the measured side is small, which is why the library never forces a broadcast
    of a table that can grow.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
