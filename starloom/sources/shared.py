"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, as in tests, a folder of this process."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not _LOCAL:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL.append(tempfile.mkdtemp(prefix="starloom-"))
        atexit.register(_remove, _LOCAL[0])
    return _LOCAL[0]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there: a cut in the lineage
    that survives lost executors. The table is removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/starloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(removed_at_end(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def removed_at_end(spark: SparkSession, path: str) -> str:
    """``path``, which is removed when the session ends."""
    atexit.register(_drop, spark, path)
    return path


def dropped(df: DataFrame) -> None:
    """Removes a table that ``staged`` wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/starloom/" in folder:
            _drop(df.sparkSession, folder)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already
        pass
