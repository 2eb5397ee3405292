"""Batch jobs that go on where they were killed: a ledger of finished units of work.

A unit is a row of keys, such as ``match_id, segment_id, chunk``. A run deals the units that are not finished into groups,
works through group after group, and after each writes the group's rows and then its units. Rows of a group count once its
units are written, so a run that dies between leaves nothing that is read; the next run does only what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


class Ledger:
    """``path`` is a folder of a shared store: ``units/group=...`` and ``rows/group=...``, Parquet both."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _groups(self) -> list[str]:
        """Groups whose units are written to the end."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/units")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _read(self, kind: str) -> DataFrame | None:
        groups = self._groups()
        return self.spark.read.parquet(*(f"{self.path}/{kind}/{g}" for g in groups)) if groups else None

    def finished(self) -> DataFrame | None:
        """The units that are done, or None before the first group is."""
        return self._read("units")

    def rows(self) -> DataFrame | None:
        """The rows of all finished units, or None before the first group is done."""
        return self._read("rows")

    def left(self, units: DataFrame) -> DataFrame:
        """Those of ``units`` that no run has finished. Null keys are keys like others."""
        todo, done = units.select(*self.keys).distinct(), self.finished()
        if done is None:
            return todo
        same = lambda df: df.select(F.struct(*self.keys).alias("_u"))
        return same(todo).join(same(done), "_u", "left_anti").select("_u.*")

    def run(self, units: DataFrame, work: Callable[[DataFrame], DataFrame], groups: int = 16) -> DataFrame:
        """Do ``work`` for all units that are left, in ``groups`` groups by hash, and give the rows of all units.

        ``work`` gets some units and returns their rows; it may be called again for units whose group was not finished, so
        it must not write anywhere itself. Its rows must follow from its units. More groups lose less when a run dies, fewer
        make larger jobs. Units that are added later are done by the next run.
        """
        todo = cut(self.left(units).withColumn("_g", F.pmod(F.xxhash64(*self.keys), F.lit(groups)).cast("int")))
        there = sorted(r["_g"] for r in todo.select("_g").distinct().collect())  # as many as groups at most
        for g in there:
            name = f"group={uuid.uuid4().hex}"
            own = todo.where(F.col("_g") == g).drop("_g")
            work(own).write.parquet(f"{self.path}/rows/{name}")
            own.coalesce(1).write.parquet(f"{self.path}/units/{name}")
        rows = self.rows()
        if rows is None:
            return work(units.select(*self.keys).limit(0))
        return rows.drop("group")
