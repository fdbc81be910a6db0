"""Where intermediate tables live, and small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Where the setting is missing, which is a local session such as a test, a
    temporary folder of this machine serves.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="folia-")
    return _LOCAL_SCRATCH[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/folia/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before the table.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folia_path = path
    _WRITTEN.append(path)
    return out


def written() -> int:
    """A mark: how many tables this driver has written with materialize()."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables written since ``mark``, but for those to keep; nothing may read them any more."""
    stay = {t._folia_path for t in keep}
    for path in _WRITTEN[mark:]:
        if path not in stay:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialize() tables that nothing will read again."""
    for t in tables:
        fs, p = hadoop_path(t.sparkSession, t._folia_path)
        fs.delete(p, True)


def free_name(name: str, *taken: str) -> str:
    """``name``, with as many underscores as keep it apart from the names that are taken, in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any supported store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffle files whose plans are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
