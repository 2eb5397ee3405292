"""A killed batch run goes on from its ledger."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from touchline.session import ship_package
from touchline.sources.ledger import Ledger

KEYS = ("match_id", "segment_id", "chunk")


@pytest.fixture()
def parts(spark):
    ship_package(spark)
    frames = spark.range(600).selectExpr("id % 3 as match_id", "if(id % 3 = 2, null, 0L) as segment_id", "floor(id / 100) as chunk", "id as frame")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/ledger"
    return frames, frames.select(*KEYS).distinct(), Ledger(spark, path, KEYS)


def job(frames, calls):
    def work(units):
        calls.append(sorted(map(str, units.collect())))
        return frames.join(units.withColumnRenamed("segment_id", "_s"), ["match_id", "chunk"]).where(
            F.col("segment_id").eqNullSafe(F.col("_s"))).groupBy(*KEYS).agg(F.sum("frame").alias("total"))
    return work


def told(df):
    return sorted(map(str, df.select(*KEYS, "total").collect()))


def test_a_killed_run_goes_on(spark, parts):
    frames, units, ledger = parts
    want = told(frames.groupBy(*KEYS).agg(F.sum("frame").alias("total")))
    calls, after = [], 3

    def dies(own):
        if len(calls) == after:
            raise OSError("killed")
        return job(frames, calls)(own)

    with pytest.raises(OSError):
        ledger.run(units, dies, groups=6)
    done = ledger.finished().count()
    assert 0 < done < units.count() and ledger.left(units).count() == units.count() - done
    again = []
    assert told(ledger.run(units, job(frames, again), groups=6)) == want
    assert not {u for c in calls for u in c} & {u for c in again for u in c}  # nothing finished is done twice
    nothing = []
    assert told(ledger.run(units, job(frames, nothing), groups=6)) == want and not nothing


def test_rows_without_their_units_do_not_count(spark, parts):
    frames, units, ledger = parts
    want = told(ledger.run(units, job(frames, []), groups=4))
    last = ledger._groups()[-1]
    os.remove(f"{ledger.path}/units/{last}/_SUCCESS")  # died while it wrote the units
    assert len(told(ledger.rows())) < len(want)
    assert told(ledger.run(units, job(frames, []), groups=4)) == want


def test_no_units(spark, parts):
    frames, units, ledger = parts
    assert ledger.run(units.limit(0), job(frames, []), groups=4).count() == 0
