"""Session and shared-folder helpers used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()


def local_session(app: str = "leafgraph", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on this machine (tests, a laptop) a temporary folder of it is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(shared_dir, "_own", None)
        if named is None:
            path = tempfile.mkdtemp(prefix="leafgraph-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            named = shared_dir._own = f"file://{path}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/leafgraph/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_forget, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes this application's tables at the end of its driver, if the context still runs."""
    with contextlib.suppress(Py4JError, ConnectionError):  # the JVM may be gone already
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
