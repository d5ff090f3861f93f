"""Reading input tables and materialising intermediate results.

``materialize`` writes a table below the folder named by ``spark.checkpoint.dir`` and reads it
back: lineage is cut, a lost executor costs only a re-read, and the files are compressed and
columnar, unlike an RDD checkpoint. Where the setting is absent and the master is local (tests, a
laptop) a temporary folder is made and set; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once in a session, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_palimpsest_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = tempfile.mkdtemp(prefix="palimpsest-code-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    archive = f"{out}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(root.rglob("*.py")):
            target.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)  # from the driver, over Spark's own file server
    context._palimpsest_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; one of our own only if none is named and all work is done on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_written: set[str] = set()


def _delete(jvm, settings, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(settings).delete(path, True)
    _written.discard(folder)


def _delete_left(jvm, settings) -> None:
    for folder in list(_written):
        with contextlib.suppress(Exception):  # the JVM may have ended without us
            _delete(jvm, settings, folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; what is not released goes at the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_delete_left, spark._jvm, spark._jsc.hadoopConfiguration())
    _written.add(path)
    out = spark.read.schema(schema).parquet(path)
    out._palimpsest_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files behind materialised tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_palimpsest_path", None)
        if path:
            _delete(df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), path)


def small_or_merged(df: DataFrame, bound: int, size: int | None = None) -> DataFrame:
    """A side of a join: broadcast if it has at most ``bound`` rows (or the given ``size`` is), else sorted and merged.

    Without a hint Spark may broadcast a side whose compressed files are small, however many rows
    they hold; the bound is in rows of a width that the caller states.
    """
    return F.broadcast(df) if (df.count() if size is None else size) <= bound else df.hint("merge")
