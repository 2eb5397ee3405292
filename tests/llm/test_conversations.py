"""Conversation repair against trying every edit, whatever the partitions."""

import hashlib
import random
from collections import defaultdict

import pytest
from brute_conversations import cheapest, damaged, verdict
from touchline.llm import conversations
from touchline.session import ship_package

ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "umpire", ""]
TEXTS = ["Who scored?", "The striker. ", "ok", "", " \n", "yes!", "go on\t", None, "long. " * 3000]
TYPES = "conv_id bigint, turn bigint, role string, text string"


def told(df):
    faults, repaired = conversations.repair_conversations(df)
    sums = {r.conv_id: r.sha256 for r in conversations.conversation_digests(repaired).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*r[1:], sums.get(r.conv_id, nothing)) for r in faults.collect()}


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    return {c: verdict(own) for c, own in by.items()}


@pytest.mark.parametrize("seed", range(4))
def test_solver(seed):
    rng = random.Random(seed)
    for _ in range(400):
        kinds = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 2, 4]) for _ in range(rng.randint(0, 60)))
        out, _, end = conversations.solve(kinds)
        rows = [("suax"[k // 2] if k < 8 else "u", k == 8, k % 2 if k < 8 else 0) for k in kinds]
        assert "".join(out) + conversations._TAIL[end][1] == cheapest(rows)[1]


def test_a_long_conversation():
    rng = random.Random(9)
    kinds = bytes(rng.choice([2, 4, 4, 2, 3, 5, 6, 8]) for _ in range(20_000))
    out, _, end = conversations.solve(kinds)
    rows = [("suax"[k // 2] if k < 8 else "u", k == 8, k % 2 if k < 8 else 0) for k in kinds]
    assert "".join(out) + conversations._TAIL[end][1] == cheapest(rows)[1]


def test_any_rows(spark):
    ship_package(spark)
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(1200)]
    df = spark.createDataFrame(rows, TYPES).selectExpr("*", "text as digest", "1 as block", "role as kind", "turn as at")
    assert told(df) == plain(rows)
    assert told(conversations.damage(df)) == plain(damaged(rows))


@pytest.mark.parametrize("parts", [1, 13])
def test_one_conversation_with_most_rows(spark, parts):
    """It lies in many partitions, and meets others at both ends."""
    rng = random.Random(parts)
    rows = [(7 if rng.random() < 0.8 else rng.randint(0, 20), rng.randint(0, 200), rng.choice(ROLES[:5]), rng.choice(["Hi.", "ok ", "well?", ""]) + str(rng.randint(0, 9)))
            for _ in range(1200)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert told(spark.createDataFrame(rows, TYPES)) == plain(rows)
        same = [(1, 3, "user", "Hi.")] * 500 + [(1, None, "assistant", "a")] * 300 + [(None, None, None, None)] * 200
        assert told(spark.createDataFrame(same, TYPES)) == plain(same)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_repaired_rows(spark):
    rows = [("x", 0, "user", "Who scored?"), ("x", 1, "user", "Anyone"), ("x", 3, "assistant", " "), ("y", 0, "assistant", "Hello."), ("z", 0, "user", "")]
    faults, repaired = conversations.repair_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in faults.collect()} == {
        "x": (1, 1, 0, 1, 1, 6, "KRD"), "y": (0, 0, 0, 0, 0, 2, "IK"), "z": (0, 1, 0, 0, 0, 3, "D")}
    ordered = [(r.conv_id, r.role, r.text) for r in repaired.orderBy("conv_id", "block", "at", "nth").collect()]
    assert ordered == [("x", "user", "Who scored?"), ("x", "assistant", "Anyone"), ("y", "user", ""), ("y", "assistant", "Hello.")]


def test_no_rows(spark):
    faults, repaired = conversations.repair_conversations(spark.createDataFrame([], TYPES))
    assert faults.count() == repaired.count() == conversations.conversation_digests(repaired).count() == 0
