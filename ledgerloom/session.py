"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state of the streaming meters.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# Fixed when a session is built: call sites in messages cost a stack walk per expression.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.ui.enabled": "false"}


def local_session(cores: str = "8", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**DEFAULTS, **STATIC, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on in a session somebody else built."""
    if spark.conf.get("spark.ledgerloom.prepared", None) is None:
        for key, value in {**DEFAULTS, "spark.ledgerloom.prepared": "true"}.items():
            spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, partition_bytes: int = 128 * 1024**2) -> int:
    """Give shuffles of ``input_bytes`` partitions that fit in executor memory; returns their number.

    At least two per core. The adaptive planner joins small ones again, so this
    is an upper bound: for 100 TB the default of 200 would mean 500 GB each.
    """
    cores = spark.sparkContext.defaultParallelism
    partitions = max(-(-input_bytes // partition_bytes), 2 * cores)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(partition_bytes))
    return partitions


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    A cluster has to name that folder. A session on one machine without it (a test)
    gets one beside its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read from there, for results that several branches of a plan use."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
