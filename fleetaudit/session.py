"""Session settings the jobs rely on."""
from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession

# Settings every run needs, on a cluster too: results must not depend on the local zone, and
# joins against a hot instance must be split at run time.
RUN_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Texts go to Python by bytes, not by 10,000 rows however long: a task holds some batches of them, on both sides.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22),
    # Streaming state on disk, entry by entry; the stateful processors need it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Largest side of a join that Spark broadcasts unasked.
BROADCASTS = "spark.sql.autoBroadcastJoinThreshold"
_GIVEN = f"fleetaudit.given.{BROADCASTS}"


def prepare(spark: SparkSession, asked_only: bool = True) -> SparkSession:
    """Apply the run settings to a session that someone else built.

    With ``asked_only`` nothing is broadcast but what a plan asks for (tables that are literals of this package). Spark
    guesses sizes from compressed files and counts what a row unfolds into as one row, so that millions of
    instances pass for a small table; and of a hundred joins of one run each may be small enough, while the driver
    collects and holds them all. Without it the session's own limit is back.
    """
    for key, value in RUN_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    given = spark.conf.get(_GIVEN, None)
    if asked_only and given is None:
        spark.conf.set(_GIVEN, spark.conf.get(BROADCASTS, None) or "")
        spark.conf.set(BROADCASTS, "-1")
    elif not asked_only and given is not None:
        spark.conf.set(BROADCASTS, given) if given else spark.conf.unset(BROADCASTS)
        spark.conf.unset(_GIVEN)
    return spark


def local_session(cores: int | str = "*", app: str = "fleetaudit", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
               .config("spark.sql.shuffle.partitions", "8"))
    for key, value in RUN_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and cut points, as the cluster names it.

    Only where it is unset (tests) a temporary folder stands in for it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _test_folder()


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetaudit-")
