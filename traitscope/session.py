"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "traitscope", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


_shipped: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, folder: str | None = None) -> None:
    """Send a package folder (this package by default) to the Python workers of a session.

    Done once per application. Not needed where the package is installed on the cluster or
    passed with --py-files.
    """
    root = folder or os.path.dirname(os.path.abspath(__file__))
    done = (spark.sparkContext.applicationId, root)
    if done in _shipped:
        return
    package = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="traitscope-py-"), f"{package}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for inner, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(inner, name)
                    archive.write(path, os.path.join(package, os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(done)


#: Texts differ in length a thousandfold, so batches for Python tasks are bounded by bytes.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python tasks of this session get."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster a
    machine-local folder would be lost with its machine, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="traitscope-"))
        folder = context.getCheckpointDir()
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts the lineage with a table that outlives any executor, pins results of range
    partitioning, and keeps a paid-for scorer or embedder from running twice.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "traitscope", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark = table.sparkSession
    own = os.path.join(shared_folder(spark), "traitscope")
    for name in {os.path.dirname(f) for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if os.path.basename(own) != path.getParent().getName():
            raise ValueError(f"not a written intermediate table: {name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
