"""Digest windows as a stream, against what each delivery allows."""

from pyspark.sql import functions as F

from mailframe.streaming import digests

SCHEMA = "mailbox string, uid_validity long, uid long, received_at timestamp_ntz, processed_at timestamp_ntz"


def run(spark, root, rows):
    """One more delivery and a run of the query over it; all rows written so far."""
    table = spark.createDataFrame(rows, "mailbox string, uid long, received string, processed string")
    table.selectExpr(
        "mailbox", "1L as uid_validity", "uid", "cast(received as timestamp_ntz) as received_at",
        "cast(processed as timestamp_ntz) as processed_at",
    ).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    stream = digests.digest_stream(source, "2 days", "America/Toronto", shards=2)
    digests.write_digests(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_timers_close_windows_and_late_mail_is_kept(spark, tmp_path):
    before = spark.conf.get(digests.PROVIDER)
    # The week of Monday 3 to Monday 10 June 2024, 08:00 in Toronto (12:00 UTC).
    out = run(spark, tmp_path, [
        ("a", 1, "2024-06-03 12:00:00", "2024-06-03 12:00:01"),
        ("a", 2, "2024-06-10 11:59:59", "2024-06-10 12:00:00"),
        ("a", 3, "2024-06-10 11:59:59", "2024-06-10 12:00:01"),
        ("b", 4, "2024-06-05 00:00:00", "2024-06-05 00:00:00"),
    ])
    # The clock stands at 8 June: only what came after its own window is known to be late.
    assert [(r.kind, r.mailbox, r.uid) for r in out.collect()] == [("late", "a", 3)]
    out = run(spark, tmp_path, [
        ("a", 5, "2024-06-04 00:00:00", "2024-06-09 00:00:00"),
        ("a", 6, "2024-06-10 12:00:00", "2024-06-13 00:00:00"),
    ])
    # Closed: the out-of-order row counts, the row of the next window does not.
    totals = {(r.mailbox, str(r.window_end)): (r.email_count, r.late_count) for r in digests.window_totals(out).collect()}
    assert totals == {("a", "2024-06-10 12:00:00"): (3, 1), ("b", "2024-06-10 12:00:00"): (1, 0)}
    # A file that comes after its window was closed: no row is dropped.
    out = run(spark, tmp_path, [("a", 7, "2024-06-04 00:00:00", "2024-06-04 00:00:00")])
    late = out.where("kind = 'late'").select("uid").orderBy("uid")
    assert [r.uid for r in late.collect()] == [3, 7]
    assert out.where("kind = 'digest'").agg(F.sum("email_count")).first()[0] == 4
    assert spark.conf.get(digests.PROVIDER) == before
