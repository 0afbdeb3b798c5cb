"""Intermediate tables in the cluster's shared folder, and joins whose broadcast side is checked for size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured in-memory estimate is below this many bytes.
BROADCAST_BYTES = 24 << 20
#: The same for a dictionary of features or clusters' places, without which every posting would be shuffled: some two million features.
DICTIONARY_BYTES = 192 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a plain local session may lack it and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrid/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the table that materialize() returned as ``df``. Only for one whose readers have all been materialised."""
    files = df.inputFiles()
    for made in list(_made):
        if any(made[1].rpartition("/")[2] in f for f in files[:1]):
            _delete(*made)
            _made.remove(made)


def discard() -> None:
    """Delete every table that materialize() wrote in this process."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # noqa: BLE001 - the session is gone at interpreter exit
            return


atexit.register(discard)


def small(rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table of so many rows may be broadcast."""
    return rows * row_bytes <= most


def sized(df: DataFrame, rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if ``rows * row_bytes`` is small; otherwise leave it to a shuffled join."""
    return F.broadcast(df) if small(rows, row_bytes, most) else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the input has fewer partitions than there are cores, as with one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
