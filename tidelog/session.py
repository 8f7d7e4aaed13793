"""Sessions, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidelog", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer."""
    b = SparkSession.builder.appName(app)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where that is unset, a temporary one serves
    a local session only; on a cluster it is an error, since executors could not reach it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: For shared folders on file: paths.  Hadoop's checksummed local files are two files and
#: four chmod processes a part; plain ones are one of each.  Other stores ignore it.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Parquet's own page checksums, which it writes by default, are verified in every store.
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    fs, where = _hadoop_path(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def settled_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a written table, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.mode("append").options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.options(**VERIFIED).schema(df.schema).parquet(path), path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: what follows reads the same rows however
    often it runs, lineage is cut, and a lost executor costs no more than its tasks.  A page
    that is damaged on the way is an error.  The table goes when the application ends."""
    return settled_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    fs, where = _hadoop_path(spark, path)
    fs.delete(where, True)
