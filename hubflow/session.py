"""Session settings that the reports rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that can be changed on a running session. No partition count and no
# broadcast threshold is fixed here: both belong to the cluster.
RUNTIME_CONF = {
    # Report times are wall-clock (timestamp_ntz); UTC keeps elapsed-time
    # functions free of daylight-saving jumps.
    "spark.sql.session.timeZone": "UTC",
    # A malformed hub id must raise where the report casts strictly.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins that keep single scans shuffle both sides directly, so a hot order,
    # trip or package is split at run time, also where that costs one exchange more.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Logs are joined to the orders of one client or period. A Bloom filter of those orders, with Spark's own limits on
    # its size and on what may be read to build it, then drops most log rows before they are shuffled.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that the caller owns."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "hubflow", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A few MB of keys may unfold to much text and JSON: keep all cores busy on small data.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        # Python call sites in error messages cost several JVM calls per expression.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
