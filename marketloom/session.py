"""SparkSession for local work and tests."""

from pyspark.sql import SparkSession

#: On a cluster, name a folder that driver and executors share instead.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/marketloom"


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master.startswith("local"):
        builder = builder.config("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = LOCAL_CHECKPOINTS
    return root.rstrip("/")
