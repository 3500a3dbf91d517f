"""Session settings shared by the tests, the benchmark and local use."""

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "scenelake", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. On a cluster, build the session as usual and name a shared `spark.checkpoint.dir`."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")   # no call-site capture per column expression
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
