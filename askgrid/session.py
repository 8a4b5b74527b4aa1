"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_SETTING = "spark.checkpoint.dir"
_local_folder: str | None = None


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("askgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """A new folder for this run's written tables, under the folder the cluster names.

    Only a local session without the setting gets a temporary folder; on a cluster a missing
    setting is an error, since a machine-local folder would not outlive its executor.
    """
    global _local_folder
    base = spark.conf.get(_CHECKPOINT_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder that all executors share")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="askgrid-")
        base = _local_folder
    return f"{base.rstrip('/')}/askgrid-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back, so that no later action runs its model calls again.

    The written table survives lost executors; nothing is recomputed from the lineage.
    """
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_measured(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """`materialise`, and sums over the rows that are taken while they are written, so no job reads them again."""
    seen = Observation()
    written = materialise(df.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()]), name)
    found = seen.get
    return written, {k: int(found.get(k) or 0) for k in sums}


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give every core a share of a table that has fewer partitions than there are cores.

    For tables of few files ahead of costly work per row. A table with enough partitions, as
    any large one has, is returned as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)
