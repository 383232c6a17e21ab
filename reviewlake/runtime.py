"""What every Spark job of the library needs: its package in Python workers, a shared folder, and tasks enough."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors once a SparkContext, through Spark itself."""
    sc = spark.sparkContext
    if getattr(sc, "_reviewlake_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(top):  # already imported from an archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="reviewlake"), "reviewlake_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._reviewlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a folder of its own, as in tests; a
    cluster must name one.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over the session's shuffle partitions.

    For work that costs a row far more than moving it: a table of few bytes is read by one or
    two tasks, however many rows it has, and AQE joins small partitions into a few by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
