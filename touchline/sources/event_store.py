"""A review log that scans bring in line a little at a time: a base, changes by number, and scans that may come in parts.

Everything is Parquet folders under one path, dealt by a hash of the match, so that a batch reads only the parts its matches lie in:

* ``base/upto=N``  - the log after the changes up to number N;
* ``delta/seq=N``  - rows that came (``gone`` false) or went (``gone`` true) with batch N, by match and event;
* ``staged/seq=N`` - rows of scans that batch N brought and that were not finished by then;
* ``scans/seq=N``  - scans that batch N applied.

A folder counts once its writer has finished (``_SUCCESS``). A batch reads what has lower numbers only and overwrites its own
folders, so a batch that is run again, whole or after a crash half-way, comes to the same end. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..operators.events import reconcile
from ..session import cut

BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("match_id"), F.lit(BUCKETS)).cast("int")


class EventStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, log: DataFrame, path: str) -> "EventStore":
        """A new store that holds ``log`` (the columns of an event log; ``match_id, event_id`` is its key)."""
        store = cls(log.sparkSession, path)
        log.limit(0).coalesce(1).write.mode("errorifexists").parquet(f"{store.path}/columns")  # partitioned writers leave no file of no rows
        log.withColumn("bucket", _bucket()).write.partitionBy("bucket").mode("errorifexists").parquet(f"{store.path}/base/upto=-1")
        return store

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of the finished folders of one kind."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        done = [s.getPath() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _drop(self, kind: str, number: int) -> None:
        jvm = self.spark.sparkContext._jvm
        name = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{'upto' if kind == 'base' else 'seq'}={number}")
        name.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)

    def _columns(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}/columns").schema

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        of = self._columns()
        own = {"delta": [*of.fields, StructField("gone", BooleanType())],
               "staged": [*of.fields, StructField("scan_id", LongType()), StructField("last", BooleanType())],
               "scans": [of["match_id"], StructField("scan_id", LongType())]}[kind]
        schema = StructType([*own, StructField("bucket", IntegerType()), StructField("seq", LongType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/seq={n}" for n in numbers))

    def log(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The log as it was before batch ``before`` (now, unless given), of some buckets only if given.

        An event's last change decides; changes are few beside the base, and only events with changes are looked up.
        """
        upto = max(n for n in self._numbers("base") if before is None or n < before)
        of = self._columns()
        base = self.spark.read.schema(StructType([*of.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/base/upto={upto}")
        changes = self._read("delta", [n for n in self._numbers("delta") if n > upto and (before is None or n < before)])
        inside = F.lit(True) if buckets is None else F.col("bucket").isin(buckets)
        columns = of.fieldNames()
        base = base.where(inside).select(*columns)
        if changes is None:
            return base
        changes = changes.where(inside)
        last = changes.groupBy("match_id", "event_id").agg(F.max_by(F.struct("gone", *columns), "seq").alias("_last"))
        keys = changes.select("match_id", "event_id").distinct()
        return base.join(keys, ["match_id", "event_id"], "left_anti").unionByName(
            last.where("not _last.gone").select(*(F.col(f"_last.{c}").alias(c) for c in columns)))

    def apply(self, rows: DataFrame, number: int, source: str | None = None) -> None:
        """Batch ``number`` of scan rows: log columns and ``scan_id, last``.

        A scan of a match is complete once a row with ``last`` is there; that row may have no ``time_s`` (it only ends the
        scan, which may have found nothing). Scans of a match count in ascending order of their id; one that is not newer than
        the last applied one changes nothing. A scan's events have ids of their own (``as_log_rows``). Rows of scans without their end wait for later batches.
        """
        of = self._columns()
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in of.fields), F.col("scan_id").cast("long").alias("scan_id"),
                          F.coalesce("last", F.lit(False)).alias("last"))
        new = cut(new.withColumn("bucket", _bucket()))
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        inside = F.col("bucket").isin(buckets)
        waiting = self._read("staged", [n for n in self._numbers("staged") if n < number])
        applied = self._read("scans", [n for n in self._numbers("scans") if n < number])
        came = new if waiting is None else new.unionByName(waiting.where(inside).drop("seq"))
        if applied is not None:
            newest = applied.where(inside).groupBy("match_id").agg(F.max("scan_id").alias("_newest"))
            came = came.join(newest, "match_id", "left").where(F.col("_newest").isNull() | (F.col("scan_id") > F.col("_newest"))).drop("_newest")
        came = cut(came)
        whole = came.groupBy("match_id", "scan_id", "bucket").agg(F.bool_or("last").alias("ended")).where("ended")
        turn = F.row_number().over(Window.partitionBy("match_id").orderBy("scan_id"))
        whole = cut(whole.select("match_id", "scan_id", "bucket", turn.alias("turn")))
        log = self.log(number, buckets)
        columns, held = log.columns, log
        for k in range(1, (whole.agg(F.max("turn")).first()[0] or 0) + 1):  # scans of one match that end in one batch
            now = whole.where(F.col("turn") == k)
            scanned = came.join(now.select("match_id", "scan_id"), ["match_id", "scan_id"], "left_semi").where(F.col("time_s").isNotNull())
            touched = now.select("match_id")
            mine = held.join(touched, "match_id", "left_semi").select(*columns)
            kept = reconcile(cut(mine), cut(scanned.select(*columns)), source)[0]
            held = cut(held.join(touched, "match_id", "left_anti").unionByName(kept.select(*columns)))
        key = ["match_id", "event_id"]
        gone = log.join(held.select(*key), key, "left_anti").withColumn("gone", F.lit(True))
        was = log.select(*key, F.struct(*columns).alias("_was"))
        fresh = held.join(was, key, "left").where(~F.col("_was").eqNullSafe(F.struct(*columns))).select(*columns, F.lit(False).alias("gone"))
        self._write(gone.unionByName(fresh).withColumn("bucket", _bucket()), "delta", number)
        self._write(new.join(whole.select("match_id", "scan_id"), ["match_id", "scan_id"], "left_anti"), "staged", number)
        self._write(whole.select("match_id", "scan_id", "bucket"), "scans", number)

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{kind}/seq={number}")

    def compact(self, upto: int) -> None:
        """Write the log after batch ``upto`` as a new base. Batches up to there must not be run again."""
        if upto not in self._numbers("base"):
            self.log(upto + 1).withColumn("bucket", _bucket()).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/base/upto={upto}")

    def clean(self) -> None:
        """Remove what the newest base has taken in. Nothing may read an older state at the time."""
        newest = self._numbers("base")[-1]
        for kind in ("base", "delta"):
            for number in self._numbers(kind):
                if number < newest or kind == "delta" and number == newest:
                    self._drop(kind, number)

    def batches(self, source: str | None = None, compact_every: int = 50):
        """A ``foreachBatch`` function that applies a stream of scan rows; see ``apply``."""

        def run(batch: DataFrame, batch_id: int) -> None:
            if batch_id and batch_id % compact_every == 0:
                self.compact(batch_id - 1)
            self.apply(batch, batch_id, source)

        return run
