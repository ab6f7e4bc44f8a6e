"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot never compiles a method of more than 8000 bytes of bytecode. Rows of
    # dozens of columns exceed that; such a stage is faster operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A task that writes few folders keeps a file open for each, and need not sort its rows by folder.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INPUT_BYTES_A_PARTITION = 4 << 20
SHUFFLE_BYTES_A_PARTITION = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options; everything about sizing is left to the cluster."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let the number of shuffle partitions follow the input, so that the rows of one task do not.

    The adaptive engine joins partitions again that turn out small, up to a size that a task
    can sort in memory: a compressed byte of a shuffled row is about ten when sorted.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_PARTITIONS, str(max(least, -(-input_bytes // INPUT_BYTES_A_PARTITION))))
    spark.conf.set(ADVISORY_BYTES, f"{min(_advised(spark), SHUFFLE_BYTES_A_PARTITION)}b")


def _advised(spark: SparkSession) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ADVISORY_BYTES))


def local_session(cpus: str | int = "*", app: str = "effectspark", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    cores = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores)
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
