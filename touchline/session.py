"""Session helpers: the settings the jobs rely on, lineage cuts that survive executor loss, and code for the workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "touchline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job assumes; anything in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only where the whole job runs in one process."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not shared and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return shared or context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that later stages read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there (iterative jobs would otherwise grow lineage).

    What already is a cut is not written again.
    """
    if getattr(df, "_is_cut", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._is_cut = True
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut whose size the planner knows from the files.

    Rounds of joins need it. A checkpoint hands on the estimate of the plan behind it, estimates of joins multiply, and
    after some twenty rounds the planner would work on numbers of millions of digits.
    """
    path = shared_path(df.sparkSession, "rounds")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files behind results of ``stored`` that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package once per application, so that jobs run from any working folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):  # else it was itself imported from a shipped archive
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(top)))
        path = os.path.join(tempfile.mkdtemp(prefix="run-"), "touchline.zip")
        with open(path, "wb") as out:
            out.write(packed.getvalue())
        context.addPyFile(path)  # the driver's file server hands it out
    _SHIPPED.add(context.applicationId)
