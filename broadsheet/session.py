"""Sessions, scratch tables in the shared folder, and the package for the executors."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, list[str]] = {}


def session(app: str = "broadsheet", **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a folder of the warehouse, which it shares too, if that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver ends, or by ``drop_scratch``."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark).rstrip('/')}/broadsheet/{app}/{name}-{uuid.uuid4().hex[:12]}"
    _folders.setdefault(app, []).append(path)
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, and the frame is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a scratch table."""
    return scratch(df, "cut")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results that still read them become unreadable."""
    app = spark.sparkContext.applicationId
    if _folders.pop(app, []):
        _delete(spark, f"{shared_root(spark).rstrip('/')}/broadsheet/{app}")


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_scratch(spark)
        except Exception:  # noqa: BLE001 - the JVM may have gone already
            pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_broadsheet_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="broadsheet-ship-")) / f"broadsheet-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._broadsheet_shipped = True
