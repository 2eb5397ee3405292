import gzip
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from touchline.llm import warc


def record(page, body=b"<p>goal</p>", refers=None, **more):
    packed = warc._record(page, f"http://x/{page}", body, len(body), warc.digest32(body), refers, "1970-01-01T00:00:00Z")
    return packed, gzip.decompress(packed)


def test_round_trip(spark):
    from touchline.session import ship_package
    ship_package(spark)
    rows = [(5, "http://a/ b\n", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "u", None), (9, "u", ""), (1, "v", "WARC/1.1\r\nx\r\n\r\n\x00"),
            (None, "n", "<p>é</p>"), (None, "n", "only"), (7, "w", "y" * 300_000), (7, "w", "y" * 300_000), (8, "w", "y" * 300_000), (9, "z", "other")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(c) for c in ("digest", "value", "_id", "path")})
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    want = Counter()
    for key, _, html in rows:
        body = (html or "").encode()
        least = first.get(html or "")
        again = least is not None and key != least
        want[key, len(body), warc.digest32(body), "revisit" if again else "response", least if again else None] += 1
    got = warc.archive_pages(df)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_files_are_bounded_by_bytes_and_any_gzip_reader_reads_them(spark, tmp_path):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://x/{i}", rng.randbytes(rng.choice([10, 900, 4000])).hex()) for i in range(300)],
                                  "page_id bigint, url string, html string").repartition(2)
    path = str(tmp_path / "archive")
    warc.write_warc(pages, path, file_bytes=20_000)
    files = [os.path.join(path, name) for name in os.listdir(path) if name.startswith("part-")]
    assert len(files) > 20 and max(map(os.path.getsize, files)) < 20_000 + 8_000
    plain = b"".join(gzip.open(name).read() for name in files)
    assert plain.count(b"WARC/1.1\r\n") == 300
    got = warc.read_warc(spark, path)
    assert got.where("reason is null").select("page_id").distinct().count() == 300 == got.count()


def test_salvage():
    parts = [record(i) for i in range(4)]
    whole = b"".join(p for p, _ in parts)
    sizes = [len(p) for p, _ in parts]
    ids = lambda data: [(p.headers["warc-record-id"][-2] if p.headers else f"gap:{p.offset}:{p.length}") for p in warc.salvage(data)]
    assert ids(whole) == ["0", "1", "2", "3"]
    bad = bytearray(whole)
    bad[sizes[0] + 40] ^= 0xFF  # inside the second member
    assert ids(bytes(bad)) == ["0", f"gap:{sizes[0]}:{sizes[1]}", "2", "3"]
    assert ids(whole[:-7]) == ["0", "1", "2", f"gap:{sum(sizes[:3])}:{sizes[3] - 7}"]
    assert ids(b"junk" + whole + b"\x1f\x8b\x08") == ["gap:0:4", "0", "1", "2", "3", f"gap:{4 + len(whole)}:3"]
    plain = b"".join(r for _, r in parts)
    assert ids(plain) == ["0", "1", "2", "3"]
    one = len(parts[0][1])
    broken = plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert ids(broken)[1:] == ["1", "2", "3"] and ids(broken)[0].startswith("gap:0:")
    flipped = bytearray(plain)
    flipped[one - 8] ^= 1  # a payload byte: the digest tells
    assert ids(bytes(flipped)) == [f"gap:0:{one}", "1", "2", "3"]
    assert ids(plain[:one] + b"garbage WARC/1.1\r\n" + whole) == ["0", f"gap:{one}:18", "0", "1", "2", "3"]
    assert ids(b"") == [] and ids(b"\x00" * 50) == ["gap:0:50"]
    assert ids(gzip.compress(b"")) == []


def test_large_member_ends_in_a_zero():
    body = os.urandom(1 << 24)
    packed, _ = record(1, body)
    assert packed[-1] == 0 and [p.block.endswith(body) for p in warc.salvage(packed)] == [True]


def test_reader_logs_gaps(spark, tmp_path):
    data = record(1)[0] + b"lost" + record(2)[0]
    (tmp_path / "part-0").write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.page_id, r.reason is None, r.length) for r in rows] == [(1, True, len(record(1)[0])), (None, False, 4), (2, True, len(record(2)[0]))]


def one_member(count, spoil=None):
    """``count`` records as one gzip stream; a payload byte of record ``spoil`` is changed before packing."""
    plain = [bytearray(record(i, os.urandom(300).hex().encode())[1]) for i in range(count)]
    if spoil is not None:
        plain[spoil][-20] ^= 1
    return gzip.compress(b"".join(map(bytes, plain)), mtime=0), [len(p) for p in plain]


def told(data):
    return [int(p.headers["warc-record-id"].rsplit(":", 1)[1][:-1]) if p.headers else "gap" for p in warc.salvage(data)]


def test_member_of_several_records_loses_only_the_bad_one():
    packed, sizes = one_member(5, spoil=2)
    assert told(packed) == [0, 1, "gap", 3, 4]
    gap = [p for p in warc.salvage(packed) if p.headers is None][0]
    assert (gap.offset, gap.length, gap.inner, gap.inner_length) == (0, len(packed), sum(sizes[:2]), sizes[2])
    assert gap.reason == "block digest differs"
    assert told(b"junk" + packed + one_member(2)[0]) == ["gap", 0, 1, "gap", 3, 4, 0, 1]


def test_broken_member_gives_what_was_inflated():
    packed, sizes = one_member(200)
    cut = told(packed[:len(packed) // 2])
    assert cut[:-1] == list(range(len(cut) - 1)) and 80 < len(cut) < 120 and cut[-1] == "gap"
    bad = bytearray(packed)
    bad[len(bad) // 2:len(bad) // 2 + 8] = b"\xff" * 8
    after, _ = one_member(3)
    got = told(bytes(bad) + after)
    assert got[:70] == list(range(70)) and got[-4:] == ["gap", 0, 1, 2]
    trailer = bytearray(packed)
    trailer[-6] ^= 1  # the checksum itself
    pieces = list(warc.salvage(bytes(trailer)))
    assert told(bytes(trailer)) == [*range(200), "gap"] and all(p.reason for p in pieces)
    # stored blocks hold the records as they are: none is given twice
    stored = gzip.compress(b"".join(record(i)[1] for i in range(3)), 0)
    assert told(stored[:-4]) == [0, 1, 2, "gap"]


def test_reader_reads_every_file(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "crawl.warc.gz").write_bytes(record(1)[0])
    (tmp_path / "below" / "plain.warc").write_bytes(record(2)[1])
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.reason is None) for r in rows) == [(0, False), (1, True), (2, True)]
