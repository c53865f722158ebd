"""Plan helpers that touch the session: the shared folder, cutting lineage, partition counts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session sets a folder of its own; on a
    cluster that is an error, as no machine's own folder would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tesserae-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def written(spark: SparkSession, path: str) -> str:
    """Notes what the application wrote to the shared folder: it goes when the driver ends, or by ``clear``. Returns the whole
    path, with its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return fs.makeQualified(at).toString()


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; results that read it must have been used before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    return path in _WRITTEN.get(spark.sparkContext.applicationId, [])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage is cut and lost executors don't repeat the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Write one small file (models, automata) to the shared folder through Hadoop's file system; returns its path."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return written(spark, path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per application (Spark serves the file)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tesserae-ship-")) / "tesserae.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
