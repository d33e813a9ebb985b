"""Session factory and shared-storage helpers.

Operators never set global session configuration; only ``build_session``
(used by scripts, tests and the bench) does. Work folders come from
``spark.checkpoint.dir`` -- the shared folder a cluster names for lineage
cuts -- and a local folder is only created when that setting is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "tidemark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Root of the shared work folder.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). When
    neither is set, a session whose driver and executors are one process gets a
    private folder, registered as the checkpoint dir, so later calls agree; on a
    cluster, where others would not see that folder, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    try:
        current = spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - Spark Connect sessions
        current = None
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
    local = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared root; ``unique`` appends a fresh id."""
    pieces = [shared_root(spark), *parts]
    if unique:
        pieces.append(uuid.uuid4().hex)
    return "/".join(p.strip("/") if i else p for i, p in enumerate(pieces))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` under the shared root and read it back.

    Ids that depend on partitions are final once written, and a lost executor
    costs the tasks that were running, not the plan behind the table."""
    path = shared_path(df.sparkSession, "stored", label, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """The paths directly under a folder of any Hadoop file system; none if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(f.getPath().toString()) for f in files.listStatus(hadoop)] if files.exists(hadoop) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file at once: readers see the old text or the new one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(conf)
    fresh, target = (files.makeQualified(p) for p in (hadoop.Path(f"{path}.{uuid.uuid4().hex}"), target))
    out = files.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.valueOf("OVERWRITE")
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(fresh, target, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if it is not there."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(conf)
    if not files.exists(hadoop):
        return None
    stream = files.open(hadoop)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def env_master(default: str = "local[*]") -> str:
    return os.environ.get("SPARK_MASTER", default)
