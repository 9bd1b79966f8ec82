"""Session construction and the shared scratch area.

Lineage is cut by writing a table into the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent (tests, local runs) is a folder of this process used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "reedbed", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` of the session, else one made for this local run."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="reedbed-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Scratch tables written by this process and not yet released.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables written so far and gives their number: for long sessions, once the results that read them have been written."""
    paths, hadoop = [_WRITTEN.pop() for _ in range(len(_WRITTEN))], spark._jsc.hadoopConfiguration()
    for path in paths:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(hadoop).delete(jvm_path, True)
    return len(paths)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back; the files go with ``release`` or when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/reedbed-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
