"""The folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may do without: then it is a temporary one."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application's own in the shared one, for intermediate tables; it is removed when the driver's process ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/matchloom/{sc.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_removed, sc, path)
    return path


_SCRATCH: set[str] = set()


def _removed(sc, path: str) -> None:
    """Removes a folder, if the JVM is still there to do it."""
    try:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except (AttributeError, OSError, Py4JError):  # it has ended
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
