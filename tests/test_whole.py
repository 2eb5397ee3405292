"""Queries over all of their tables: every frame, landmark and clip has its result."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ("projected_landmarks_whole", "asof_telemetry_clips", "in_play_clips", "image_possession_clips")


@pytest.mark.parametrize("name", NAMES)
def test_whole_query_equals_its_twin(spark, name):
    ok, note = compare(spark, duck(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert ok and "EMPTY" not in note, note


def test_all_landmarks_and_frames(spark):
    rows = entry.queries()["projected_landmarks_whole"](spark, FOLDER).select("frame", "label").collect()
    assert len({r.label for r in rows}) == 17 and any(r.frame % 40 for r in rows)


@pytest.mark.parametrize("name", NAMES[1:])
def test_both_clips(spark, name):
    assert {r.clip for r in entry.queries()[name](spark, FOLDER).select("clip").distinct().collect()} == {0, 1}
