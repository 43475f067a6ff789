"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_folder: list[str] = []


def build_session(app: str = "framekit", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on and UTC time; ``conf`` overrides any setting."""
    settings: dict[str, object] = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # the JVM never compiles longer methods; Spark then makes several short ones of a stage instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a session on one machine
    (``local[...]``) may fall back on a temporary folder; elsewhere executors could not see it.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        if not _own_folder:  # one for this process, gone with it
            _own_folder.append(tempfile.mkdtemp(prefix="spark-framekit-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on whatever file system."""
    system, hadoop = _place(spark, path)
    return system.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    system, hadoop = _place(spark, path)
    system.delete(hadoop, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
