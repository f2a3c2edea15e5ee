"""Session helpers: shared folders and file system checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A dictionary is broadcast only if all files it is made from have this size at most, compressed.
BROADCAST_FILE_BYTES = 8 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session without that
    setting (a test) gets a temporary folder; a cluster session without it is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqstats-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts its lineage for reuse."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 if there is none."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(hadoop_path).getLength() if system.exists(hadoop_path) else 0


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Let ``source`` take the place of ``target``; what was there goes when the new one is in place."""
    names = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target, f"{target}_old")]
    system = names[0].getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(names[2], True)
    if system.exists(names[1]) and not system.rename(names[1], names[2]):
        raise OSError(f"{target} cannot be replaced")
    if not system.rename(names[0], names[1]):
        raise OSError(f"{source} cannot be moved to {target}")
    system.delete(names[2], True)
    spark.catalog.refreshByPath(target)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    """One rename to a name that is free."""
    names = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    system = names[0].getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(names[1]) or not system.rename(*names):
        raise OSError(f"{source} cannot be renamed to {target}")


def small_on_disk(df: DataFrame, limit: int = BROADCAST_FILE_BYTES) -> bool:
    """Whether all files a frame is made from are small together. Looks at the files only and starts no job.

    A frame that is not read from files has no known size and is not small.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files or len(files) > 1_000:
        return False
    total = 0
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if total > limit:
            return False
    return True
