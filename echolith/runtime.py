"""Session settings and shared storage for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "echolith", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus or '*'}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_echolith_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="echolith-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    target = f"{folder}/echolith_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(target)
    context._echolith_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset, a folder is chosen and set
    on the session: a temporary one in local mode, where driver and executors are one process; else one
    beside the warehouse, if that is on a file system that all machines see, and an error if it is not.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    if spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="echolith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = f"file://{folder}"
    else:
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_echolith_work"
        if hadoop_path(spark, place)[0].getUri().getScheme() == "file":
            raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(place)
    return place


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/echolith/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: what is read later does not depend on shuffle files, so that the loss of
    an executor costs no more than the tasks it ran. The files are deleted when the driver ends, or before by
    ``release``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if not _MADE:
        atexit.register(release, spark)
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables written by ``materialize`` and not yet deleted.
_MADE: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete all tables that ``materialize`` wrote; their number. Frames that read them can't be used any more."""
    paths, done = list(_MADE), 0
    _MADE.clear()
    for path in paths:
        try:
            fs, where = hadoop_path(spark, path)
            done += bool(fs.delete(where, True))
        except Exception:  # the session is gone, and a temporary folder with it
            break
    return done


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for ``path``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
