"""Session helpers: a builder for local runs and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "fieldloom", driver_memory: str = "12g", shared: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made for local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a new local one only when unset on local[*]."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark.sparkContext.applicationId not in _own:
        _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="fieldloom-")
    return _own[spark.sparkContext.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """New, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/fieldloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage in a way that survives lost executors, and freezes values
    (such as slice numbers) that must be the same in every later use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what ``materialize`` wrote for ``df``, which nothing may read any more.

    Only folders that ``scratch_path`` named for this application are touched.
    """
    spark = df.sparkSession
    own = f"/fieldloom/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of what has ended.

    It does so once the driver's collectors have found their plans, which may be long after the last use where the driver has little to do.
    """
    gc.collect()
    spark._jvm.System.gc()
