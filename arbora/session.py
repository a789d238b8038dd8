"""Session helpers: how tables are read, where intermediate tables go, how the package reaches executors."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: spark.checkpoint.dir, or on one machine a temporary one if none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/arbora-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that stash() wrote, once nothing that is still to run reads it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/arbora-" in path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers unless they inherit a path to it (PYTHONPATH or the working folder)."""
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(ROOT) in [*seen, os.path.realpath(os.getcwd())] or app in _shipped:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="arbora-zip-"), "arbora_src"), "zip", ROOT, "arbora")
    spark.sparkContext.addPyFile(made)
    if made in sys.path:
        sys.path.remove(made)
    _shipped.add(app)
