"""A table as a log of commits, for stores that several writers share.

A writer puts its rows in a folder of their own and then claims the next commit number, which
only one writer can have; who comes second takes the number after it, so that no rows are lost.
A snapshot commit stands for all commits before it, and is claimed only if nothing was committed
since it was read.  Readers see the commits that were claimed when they looked.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"


class Log:
    """Rows of one schema below a folder; ``__commit`` is the number of the commit that brought a row."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path.rstrip("/"), ddl

    # --- the folder, through Hadoop, so that any store that Spark reads will do -------------

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{COMMITS}")
        return where.getFileSystem(conf), where

    def _claim(self, number: int, data: str, whole: bool) -> bool:
        """Make the commit's file; False if the number is taken."""
        text = json.dumps({"data": data, "whole": whole})
        fs, where = self._fs()
        fs.mkdirs(where)
        if fs.getUri().getScheme() == "file":  # Hadoop's local files know no exclusive creation
            local = os.path.join(where.toUri().getPath(), f"{number:012d}.json")
            beside = f"{local}.{uuid.uuid4().hex}"
            with open(beside, "w") as f:
                f.write(text)
            try:
                os.link(beside, local)  # whole or not at all
            except FileExistsError:
                return False
            finally:
                os.unlink(beside)
            return True
        target = self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{number:012d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:  # a py4j error around FileAlreadyExistsException
            if fs.exists(target):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def commits(self) -> list[tuple[int, str, bool]]:
        """(number, data folder, whole) since the last snapshot, oldest first."""
        fs, where = self._fs()
        if not fs.exists(where):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.text([f"{self.path}/{COMMITS}/{n}" for n in names]).select("value", F.col("_metadata.file_name").alias("name")).collect()
        found = sorted((int(r["name"].split(".")[0]), *(json.loads(r["value"])[k] for k in ("data", "whole"))) for r in rows)
        last = max((k for k, c in enumerate(found) if c[2]), default=0)
        return found[last:]

    # --- rows --------------------------------------------------------------------------------

    def read(self, commits: list[tuple[int, str, bool]] | None = None) -> DataFrame:
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], f"{self.ddl}, __commit long")
        rows = self.spark.read.schema(self.ddl).parquet(*[f"{self.path}/{data}" for _, data, _ in commits])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        number = F.element_at(F.create_map(*[F.lit(x) for n, data, _ in commits for x in (data, n)]), folder)
        return rows.select("*", number.cast("long").alias("__commit"))

    def _write(self, rows: DataFrame) -> str:
        data = f"data-{uuid.uuid4().hex}"
        rows.select(*[f.strip().split()[0] for f in self.ddl.split(", ")]).write.parquet(f"{self.path}/{data}")
        return data

    def _next(self) -> int:
        fs, where = self._fs()
        if not fs.exists(where):
            return 1
        return 1 + max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where)), default=0)

    def append(self, rows: DataFrame) -> int:
        """The number under which the rows were committed, after whatever others committed meanwhile."""
        data = self._write(rows)
        number = self._next()
        while not self._claim(number, data, False):
            number += 1
        return number

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> int | None:
        """Commit ``fold`` of all rows as a snapshot; None if another commit came first."""
        commits = self.commits()
        if not commits:
            return None
        number = commits[-1][0] + 1
        return number if self._claim(number, self._write(fold(self.read(commits))), True) else None
