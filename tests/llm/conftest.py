import pytest


@pytest.fixture(scope="session")
def note_rows():
    """Notes of reviewed events: empty, null, repeated, very long, with ties, marks, line ends and several scripts."""
    long = " ".join(f"pass{i % 97} wing{i % 13}" for i in range(30_000))
    notes = ["Shot from range, saved.", "", None, " ", "\n\n", "Shot from range, saved.", "Ćorner\nkick  taken 'short'\t!",
             "ǅ ﬁne İstanbul ẞ naïve é don't we'll", long, "a", "tackle\r\nwon here\u0085x\x1cy", "goal " * 40]
    rows = [(i, n) for i, n in enumerate(notes)]
    return [*rows, (3, " "), (None, "no id")]


@pytest.fixture(scope="session")
def notes_df(spark, note_rows):
    from pyspark.sql import functions as F
    from touchline.session import ship_package
    ship_package(spark)
    df = spark.createDataFrame(note_rows, "event_id bigint, note string")
    return df.withColumns({c: F.lit(c) for c in ("key", "text", "start", "length", "_shard", "source", "team")})


@pytest.fixture(scope="session")
def no_notes(spark):
    return spark.createDataFrame([], "event_id bigint, note string, text int")
