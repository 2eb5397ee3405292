"""Log lines by byte range: the same lines whatever the ranges, and each line once from logs that grow."""

import io
import random

import pytest

from touchline.sources import log_lines as L
from touchline.sources import telemetry as T


def plain(data):
    out, at = [], 0
    for line in data.split(b"\n"):
        out.append((at, line))
        at += len(line) + 1
    return out[:-1] if not out[-1][1] else out


def test_ranges_give_every_line_once():
    rng = random.Random(4)
    logs = [b"", b"\n", b"one", b"one\n", b"\n\na\n\n", b"x" * 40 + b"\n" + b"y" * 40]
    logs += [b"\n".join(b"l" * rng.choice([0, 1, 3, 17]) for _ in range(30)) for _ in range(20)]
    for data in logs:
        for step in (1, 2, 7, 1000):
            for block in (1, 5, 64):
                got = [(int(p), x) for at in range(0, len(data), step)
                       for begins, lines in L.lines_between(io.BytesIO(data), at, min(at + step, len(data)), block)
                       for p, x in zip(begins, lines)]
                assert got == plain(data), (data, step, block)


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_bytes("é1\r\né2\n".encode())
    (tmp_path / "a.txt").write_bytes(b"bad \xff\n\nlast")
    (tmp_path / "_done").write_bytes(b"no\n")
    (tmp_path / "empty").write_bytes(b"")
    rows = sorted((r.path.rsplit("/", 1)[1], r.pos, r.line) for r in L.read_lines(spark, str(tmp_path), 4).collect())
    assert rows == [("a.txt", 0, "bad �"), ("a.txt", 6, ""), ("a.txt", 7, "last"), ("x.txt", 0, "é1"), ("x.txt", 5, "é2")]
    one = L.read_lines(spark, [str(tmp_path / "a.txt"), "file://" + str(tmp_path / "b")])
    assert one.count() == 5
    with pytest.raises(Exception, match="missing"):
        L.read_lines(spark, str(tmp_path / "missing")).count()


def test_telemetry_does_not_hang_on_ranges(spark, tmp_path):
    lines = []
    for n in range(400):
        fin = f"Frame{n} FIN:x10 y20 V1 YawErr2 out3 Ctrl:X4 Y5 zoomSz{n % 9} In:1 Lock:1/3"
        lines += [f"2024-05-01 10:{n // 60:02d}:{n % 60:02d}.000", *([fin[:20], fin[20:]] if n % 3 == 0 else [fin]), f"BallSz{n % 7}"]
        lines += ["nothing known"] if n % 50 == 9 else []
    path = tmp_path / "log.txt"
    path.write_text("\n".join(lines))
    results = []
    for step in (3001, 1 << 20):
        frames, unknown = T.read_telemetry(spark, str(path), step)
        results.append((sorted(map(str, frames.collect())), unknown.first().unknown_lines))
    assert results[0] == results[1] and len(results[0][0]) == 400 and results[0][1] == 8


def test_a_growing_log_gives_each_whole_line_once(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()

    def advance():
        stream = L.follow_lines(spark, str(logs), 16).writeStream.option("checkpointLocation", str(tmp_path / "marks")).trigger(
            availableNow=True).format("parquet").start(out)
        stream.awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], r.pos, r.line) for r in spark.read.parquet(out).collect())

    (logs / "a").write_text("first line of the log\nsecond, not who")
    want = [("a", 0, "first line of the log")]
    assert advance() == want
    with open(logs / "a", "a") as f:
        f.write("le\nthird\n")
    (logs / "b").write_text("other\n")
    want += [("a", 22, "second, not whole"), ("a", 40, "third"), ("b", 0, "other")]
    assert advance() == sorted(want)
    assert advance() == sorted(want)  # nothing new


def test_many_small_logs_are_few_tasks(spark, tmp_path):
    for n in range(30):
        (tmp_path / f"{n:02}.log").write_text("".join(f"{n} {i}\n" for i in range(50)))
    rows = L.read_lines(spark, str(tmp_path), 64, 4096)
    assert rows.rdd.getNumPartitions() <= 5
    got = sorted((r.path[-6:-4], r.line) for r in rows.collect())
    assert got == sorted((f"{n:02}", f"{n} {i}") for n in range(30) for i in range(50))
