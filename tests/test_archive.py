import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mailframe import schemas
from mailframe.operators.archive import archive_paths, new_archive_rows


def paths_of(spark, rows, archived=None):
    df = spark.createDataFrame(
        rows, "mailbox string, uid_validity long, uid long, message_id string, local string, raw string"
    ).withColumn("received_local", F.to_timestamp_ntz("local")).withColumn(
        "raw", F.col("raw").cast("binary")
    ).withColumn("sha", F.sha2("raw", 256))
    return df, archive_paths(df, archived)


def test_paths_and_collisions(spark):
    when = "2026-02-28 23:30:00"
    raw, out = paths_of(spark, [
        ("a", 1, 10, "<message/id@example.test>", when, "one"),
        ("a", 1, 11, "message/id@example.test", when, "two"),
        ("a", 1, 12, "message/id@example.test", when, "one"),
        ("a", 1, 44, "", when, "x"), ("a", 1, 44, None, when, "y"),
    ])
    got = [r.raw_path for r in out.orderBy("uid", "raw").collect()]
    base = "2026/02/message_id_example.test"
    import hashlib
    two = hashlib.sha256(b"two").hexdigest()[:12]
    assert got[:3] == [f"{base}.eml", f"{base}-{two}.eml", f"{base}.eml"]
    assert sorted(p.startswith("2026/02/uid-44") for p in got[3:]) == [True, True]
    assert len(set(got[3:])) == 2 and "2026/02/uid-44.eml" in got[3:]


def test_archived_bytes_own_the_base(spark):
    when = "2026-02-01 00:00:00"
    raw, out = paths_of(spark, [("a", 1, 1, "m", when, "one"), ("a", 1, 2, "m", when, "two")])
    empty = spark.createDataFrame([], schemas.ARCHIVE)
    first = new_archive_rows(out, raw, empty)
    stored = spark.createDataFrame(first.collect(), schemas.ARCHIVE)
    assert stored.count() == 2
    # The same mail again, and a newcomer in front of it: nothing moves, one row is new.
    raw, out = paths_of(
        spark,
        [("a", 1, 0, "m", when, "zero"), ("a", 1, 1, "m", when, "one"), ("a", 1, 2, "m", when, "two")],
        stored,
    )
    again = new_archive_rows(out, raw, stored).collect()
    assert [bytes(r.raw) for r in again] == [b"zero"]
    assert again[0].raw_path != again[0].base_path and again[0].year == "2026"


def test_hash_clash_fails(spark):
    when = "2026-02-01 00:00:00"
    raw, out = paths_of(spark, [("a", 1, 1, "m", when, "one")])
    stored = spark.createDataFrame(
        new_archive_rows(out, raw, spark.createDataFrame([], schemas.ARCHIVE)).collect(),
        schemas.ARCHIVE,
    )
    other = stored.withColumn("sha", F.lit("0" * 64))
    with pytest.raises(PySparkException, match="hash collision"):
        new_archive_rows(out, raw, other).collect()
