"""Session helpers: a default session, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it through PYTHONPATH or the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if root in map(os.path.abspath, filter(None, reachable)) or getattr(sc, "_tessera_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(os.path.join(root, "tessera")):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors reach.

    A cluster names it in ``spark.checkpoint.dir``; a temporary folder serves only a local master, that
    is tests. On any other master a missing setting is an error: each machine would write to its own
    disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


#: Spark takes the size of a file for that of its rows when it decides on a broadcast; rows are larger.
COMPRESSION = 10
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only the tasks it was running. The folder is
    removed when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    if int(float(spark.conf.get(_FACTOR, "1.0"))) < COMPRESSION:
        spark.conf.set(_FACTOR, str(float(COMPRESSION)))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever file system it is on."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone at exit
        pass
