"""A session with the settings these reports are meant for."""

from pyspark.sql import SparkSession

# On a cluster these usually come from spark-defaults.  Results do not depend on them; how well a
# hot key is spread does: joins leave that to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # call sites of every column are only for error messages and slow down plan building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(name: str = "tradeweave", **settings: str) -> SparkSession:
    """``settings`` use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``."""
    builder = SparkSession.builder.appName(name)
    named = {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in {**SETTINGS, **named}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
