"""Session defaults and places where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone pinned to UTC."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only on a local master a session that names none (tests, a single machine) gets a temporary folder; elsewhere the
    executors' own disks would each hold a part of what is written, so that is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    own = getattr(spark, "_inkwell_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark._inkwell_shared = own
    return own


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder of any file system Spark reads; empty where there is no such folder."""
    fs, p = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def staged(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back; by: a string column of few values that readers will filter on.

    The result has no lineage, so a lost executor costs nothing upstream, and several
    readers don't repeat the work. An empty frame keeps its schema. What is written stays
    until clear_staged.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    spark._inkwell_staged = [*getattr(spark, "_inkwell_staged", []), path]
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Remove what this session has staged, once nothing that reads it is wanted any more; the number of folders removed."""
    paths = getattr(spark, "_inkwell_staged", [])
    for path in paths:
        remove_folder(spark, path)
    spark._inkwell_staged = []
    return len(paths)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when df has at most max_rows rows; reads no further than that many."""
    return df.limit(max_rows + 1).count() <= max_rows
