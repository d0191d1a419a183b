"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


_written: dict[int, tuple[weakref.ref, str]] = {}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """A folder of this application that every executor can reach.

    It is below ``spark.checkpoint.dir``, or below the warehouse where that is unset, and is removed
    when the driver's file system closes. A warehouse in a folder of the driver's host is no shared one,
    so away from a local master the first has to be set there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the written copy.

    Readers of the copy prune columns and know its size, so adaptive execution picks the joins.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(copy)] = (weakref.ref(copy), path)
    return copy


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote. Only for tables whose every reader is itself written:
    an executor that is lost later must not need them again."""
    for table in tables:
        copy, path = _written.pop(id(table), (None, None))
        if copy is not None and copy() is table:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a scan at least as many partitions as the session has cores, before costly text work.

    Files with one row group, or quoted files that cannot be split, arrive as single partitions.
    A scan that already has enough partitions, as any large table does, is left as it is. Call it
    on scans only: counting the partitions of a shuffled table would run the shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
