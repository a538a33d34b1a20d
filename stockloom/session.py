"""Session set-up and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster use its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stockloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made for local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a session with a local master may leave it unset. It gets one folder of this machine,
    which goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="stockloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/stockloom-{spark.sparkContext.applicationId}"


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh subfolder of the application's folder for one run."""
    return f"{own_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all stage tables of this application. Call it once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A lost executor then costs no replay of what went before, and plans know the true size, so
    that small tables are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = run_dir(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
