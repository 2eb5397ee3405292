"""Camera-controller text logs as tables: one row per logged frame.

Lines are read split by split (a log is never one row), classified and cut apart with column expressions, and merged per
frame with aggregates. Lines that parse as nothing are tried joined with their neighbors, as the writer splits some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import prefix, runs
from ..session import stored
from .log_lines import PARTITION_BYTES, read_lines

# The line formats of the log
STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)$"
MOTION = r"^Frame(\d+) fps(\d+) SZ(\d+) Yaw(-?[\d.]+) Pit(-?[\d.]+)$"
FIN = (r"^Frame(\d+) FIN:x(-?\d+) y(-?\d+) V(-?\d+) YawErr(-?\d+) out(-?\d+) "
       r"Ctrl:X(-?\d+) Y(-?\d+) (?:\+Zoom:[\d.]+ )?zoomSz(\d+) In:(\d+) Lock:(\d+)/(\d+)$")
BALL_SIZE = r"^BallSz(\d+)(?: TSz(\d+))?(?: StaX(-?\d+) Ballx(\d+) OutX(\d+))?( BallFail)?$"
BALL_TRACK = r"^T(\d+) RB(\d+) xv(-?\d+) yv(-?\d+) xm(-?\d+) ym(-?\d+)$"
BALL_BOX = r"^BT(\d+)(?:maySta)?(RB|PB)\((-?\d+),(-?\d+),(\d+),(\d+)\)V(-?\d+)F?to([LR]) Ballx(\d+) OutX(\d+)$"
FILTER = r"^AFilterP(\d+) mot(\d+) Deque(\d+)((?:\(V(-?\d+),x(-?\d+)\))+)$"
FAST = r"^Fast(\d+) Crowdx(\d+)$"
BOUNDARY = r"^boundary(\d+) [LR]X(\d+) autoCenterX(\d+)$"
CENTER = r"^autoCenterX(\d+)$"
HEADER = r"^(SDKV[\d.]+-[\w-]+|Soccer .+|SDKStart|SDK~|SDKStop|SetPitchInitialAngle.*)$"
CONTENT = {"motion": MOTION, "fin": FIN, "size": BALL_SIZE, "track": BALL_TRACK, "box": BALL_BOX, "filter": FILTER,
           "fast": FAST, "boundary": BOUNDARY, "center": CENTER}
KEY_FIELDS = ("yaw_deg", "pitch_deg", "zoom_sz", "fin_zoom_sz", "lock_a", "ball_sz", "ball_x")
LONGEST = 200


def read_split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text logs as ``path, pos, line``, from stores that only Spark's own readers open.

    A split's rows keep their order, and a line takes at least one byte, so split start plus row number in the split is
    an order over the file without reading it in one task. Elsewhere ``log_lines.read_lines`` gives true positions.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    first = raw.groupBy("path", "_at").agg(F.min("_id").alias("_first"))
    return raw.join(first, ["path", "_at"]).select("path", (F.col("_at") + F.col("_id") - F.col("_first")).alias("pos"), "line")


def _kind(line: Column) -> Column:
    kind = F.when(line.rlike(STAMP), "stamp").when(line.rlike(HEADER), "header")
    for name, pattern in CONTENT.items():
        kind = kind.when(line.rlike(pattern), name)
    return kind.otherwise("loose")


def _rejoined(loose: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines put together from neighbors in a run of loose lines (``path, pos, line, kind``), and ``path, unknown_lines``.

    The writer may split a line in two or three, at a blank or within a word. Each loose line is tried with the next one, then with the
    next two; stamps between them do not matter, but a line that parses alone does. Where two joins overlap, the earlier
    one counts. What is left between joins is unknown: once for a stretch of lines, and again for about each further
    ``LONGEST`` characters of it.
    """
    run = Window.partitionBy("path", "run").orderBy("pos")
    after = [F.lead(F.struct("line", "pos")).over(run), F.lead(F.struct("line", "pos"), 2).over(run)]
    rows = loose.withColumns({"one": after[0], "two": after[1]})

    def first_of(*texts: Column) -> Column:
        return F.coalesce(*(F.when(_kind(t) != "loose", t) for t in texts))

    pair = [F.concat("line", F.lit(gap), "one.line") for gap in ("", " ")]
    rows = rows.withColumn("pair", first_of(*pair))
    rows = rows.withColumn("triple", F.when(F.col("pair").isNull(), first_of(*(F.concat(p, F.lit(gap), "two.line") for p in pair for gap in ("", " ")))))
    rows = rows.withColumn("parts", F.when(F.col("pair").isNotNull(), 2).when(F.col("triple").isNotNull(), 3).otherwise(1))
    reach = F.greatest(F.coalesce(F.lag("parts").over(run) - 1, F.lit(0)), F.coalesce(F.lag("parts", 2).over(run) - 2, F.lit(0)))
    rows = rows.withColumn("reached", reach)
    rows = rows.withColumn("begins", (F.col("parts") > 1) & (F.col("reached") == 0))
    begun = [F.coalesce(F.lag(F.col("begins") & (F.col("parts") > k)).over(run) if k == 1 else F.lag(F.col("begins") & (F.col("parts") > k), k).over(run), F.lit(False)) for k in (1, 2)]
    rows = rows.withColumn("part", F.col("begins") | begun[0] | begun[1])
    joined = rows.where("begins").select("path", F.when(F.col("parts") == 2, F.col("one.pos")).otherwise(F.col("two.pos")).alias("pos"),
                                         F.coalesce("pair", "triple").alias("line"))
    rest = rows.withColumn("stretch", F.sum(F.col("part").cast("int")).over(run)).where("not part")
    upto = Window.partitionBy("path", "run", "stretch").orderBy("pos")
    rest = rest.withColumn("piece", F.floor((F.sum(F.length("line")).over(upto) - F.length("line")) / (LONGEST + 1)))
    lost = rest.select("path", "run", "stretch", "piece").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("unknown_lines"))
    return joined.withColumn("kind", _kind(F.col("line"))), lost


def _group(pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))


def _read_off(rows: DataFrame) -> DataFrame:
    """Add the frame that a line names and the time of a stamp."""
    kind = F.col("kind")
    named = F.when(kind == "motion", _group(MOTION, 1)).when(kind == "fin", _group(FIN, 1)).cast("long")
    return rows.withColumns({"named": named, "stamp": F.when(kind == "stamp", F.try_to_timestamp("line").cast("double"))})


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames ``path, frame, time_s, ...`` and unknown-line counts ``path, unknown_lines``."""
    rows = lines.select("path", "pos", F.trim("line").alias("line")).where(F.col("line") != "")
    # several steps ask for the classified lines, so they are read and classified once
    rows = stored(_read_off(rows.withColumn("kind", _kind(F.col("line")))))
    loose = F.col("kind") == "loose"
    content = rows.where(~F.col("kind").isin("stamp", "header")).select("path", "pos", "kind", F.when(loose, F.col("line")).alias("line"))
    joined, lost = _rejoined(stored(runs(content, ["path"], "pos", loose, 65536.0)))
    unknown = rows.select("path").distinct().join(lost, "path", "left").na.fill(0, ["unknown_lines"])
    used = rows.where(~F.col("kind").isin("header", "loose")).unionByName(_read_off(joined))

    line = F.col("line")
    created = used.where(F.col("named").isNotNull()).groupBy("path", "named").agg(F.min("pos").alias("pos")).withColumn(
        "fresh", F.col("named"))
    # the first stamp, before what a row is given later
    begin = used.groupBy("path").agg(F.min_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("pos"))).alias("begin"))
    used = used.join(created, ["path", "named", "pos"], "left")
    used = prefix(used, ["path"], ["pos"], 65536.0, fills={"latest": F.col("fresh"), "now": F.col("stamp")})
    used = used.join(begin, "path").withColumn("frame", F.coalesce("named", "latest")).where(
        F.col("frame").isNotNull() & (F.col("kind") != "stamp"))
    pos = F.col("pos")

    def of(kind, value):
        """A value that only lines of a kind are searched for."""
        return F.when(F.col("kind") == kind, value)

    def last(kind, pattern, i, to):
        """The last value written by a kind of line."""
        value = of(kind, _group(pattern, i).cast(to))
        return F.max_by(value, F.when(value.isNotNull(), pos))

    ball_x = F.when(F.col("kind") == "size", _group(BALL_SIZE, 4)).when(F.col("kind") == "box", _group(BALL_BOX, 9)).cast("double")
    out_x = F.when(F.col("kind") == "size", _group(BALL_SIZE, 5)).when(F.col("kind") == "box", _group(BALL_BOX, 10)).cast("double")
    # a size line without a target clears it
    target = F.max_by(of("size", F.struct(_group(BALL_SIZE, 2).cast("int").alias("v"))), F.when(F.col("kind") == "size", pos))["v"]
    failed = F.max_by(of("size", _group(BALL_SIZE, 6).isNotNull()), F.when(F.col("kind") == "size", pos))
    pairs = of("filter", F.transform(F.regexp_extract_all(line, F.lit(r"\((V-?\d+,x-?\d+)\)"), F.lit(1)), lambda p: F.struct(
        F.regexp_extract(p, r"V(-?\d+)", 1).cast("double").alias("v"), F.regexp_extract(p, r"x(-?\d+)", 1).cast("double").alias("x"))))
    box = of("box", F.struct(*[_group(BALL_BOX, i).cast("double").alias(n) for i, n in ((3, "x"), (4, "y"), (5, "w"), (6, "h"))]))
    time = F.min_by(F.col("now") - F.col("begin"), F.when(F.col("named").isNotNull() & F.col("now").isNotNull(), pos))
    frames = used.groupBy("path", "frame").agg(
        time.alias("time_s"),
        last("motion", MOTION, 4, "double").alias("yaw_deg"), last("motion", MOTION, 5, "double").alias("pitch_deg"),
        last("motion", MOTION, 3, "int").alias("zoom_sz"), last("fin", FIN, 9, "int").alias("fin_zoom_sz"),
        last("fin", FIN, 11, "int").alias("lock_a"), last("fin", FIN, 12, "int").alias("lock_b"),
        last("fin", FIN, 2, "double").alias("fin_x"), last("fin", FIN, 3, "double").alias("fin_y"),
        last("fin", FIN, 5, "double").alias("yaw_err"), last("fin", FIN, 7, "double").alias("ctrl_x"),
        last("fin", FIN, 8, "double").alias("ctrl_y"),
        last("size", BALL_SIZE, 1, "int").alias("ball_sz"), target.alias("target_sz"),
        F.coalesce(failed, F.lit(False)).alias("ball_fail"),
        F.max_by(ball_x, F.when(ball_x.isNotNull(), pos)).alias("ball_x"),
        F.max_by(out_x, F.when(out_x.isNotNull(), pos)).alias("out_x"),
        last("filter", FILTER, 1, "int").alias("a_filter_p"), last("filter", FILTER, 2, "int").alias("motion"),
        F.max_by(pairs, F.when(F.col("kind") == "filter", pos)).alias("deque"),
        last("fast", FAST, 1, "int").alias("fast"), last("fast", FAST, 2, "double").alias("crowd_x"),
        last("track", BALL_TRACK, 1, "int").alias("ball_track_id"), last("track", BALL_TRACK, 3, "double").alias("ball_xv"),
        last("track", BALL_TRACK, 4, "double").alias("ball_yv"), last("track", BALL_TRACK, 5, "double").alias("ball_xm"),
        last("track", BALL_TRACK, 6, "double").alias("ball_ym"),
        F.max_by(box, F.when(F.col("kind") == "box", pos)).alias("ball_box"),
        F.max_by(of("box", _group(BALL_BOX, 8)), F.when(F.col("kind") == "box", pos)).alias("ball_dir"))
    return frames.withColumn("locked", F.coalesce(F.col("lock_a") > 0, F.lit(False))), unknown


def read_telemetry(spark: SparkSession, paths: str | Sequence[str], partition_bytes: int = PARTITION_BYTES,
                   task_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and unknown-line counts of log files, read by byte range (see ``log_lines``)."""
    return parse_lines(read_lines(spark, paths, partition_bytes, task_bytes))


def merge_telemetry(frames: DataFrame, keys: Sequence[str], file_no: str = "file_no") -> DataFrame:
    """Overlapping logs: per frame the fullest record; the earlier file on ties."""
    filled = F.lit(0)
    for c in KEY_FIELDS:
        filled = filled + F.col(c).isNotNull().cast("int")
    row = F.struct(*[F.col(c) for c in frames.columns])
    best = frames.groupBy(*keys, "frame").agg(F.max_by(row, F.struct(filled.alias("n"), (-F.col(file_no)).alias("f"))).alias("r"))
    return best.select("r.*")


def pair_logs(clips: DataFrame, logs: DataFrame) -> DataFrame:
    """The log of every clip by the clock time in its name; a match with one unpaired clip gives no rows.

    ``clips``: ``match_id, path``; ``logs``: ``match_id, log``.
    """
    def base(c):
        return F.regexp_extract(c, r"([^/]*)$", 1)

    clock = F.regexp_extract(base(F.col("path")), r"(\d{2})[:-](\d{2})[:-](\d{2})", 0)
    c = clips.withColumn("_clock", F.translate(clock, "-", ":"))
    stamps = F.regexp_extract_all(base(F.col("log")), F.lit(r"(?=(\d{2}:\d{2}:\d{2}))"), F.lit(1))
    named = logs.select("match_id", "log", F.explode(F.array_distinct(stamps)).alias("_clock"))
    first = named.groupBy("match_id", "_clock").agg(F.min_by("log", base(F.col("log"))).alias("log"))
    paired = c.join(first, ["match_id", "_clock"], "left")
    whole = paired.groupBy("match_id").agg(F.bool_and(F.col("log").isNotNull()).alias("_all")).where("_all")
    return paired.join(whole.select("match_id"), "match_id", "left_semi").select("match_id", "path", "log")
