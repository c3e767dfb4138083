from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailframe.functions import timing
from mailframe.operators import digest as dg

ROW = (
    "mailbox string, uid_validity long, uid long, received_at timestamp, processed_at timestamp, "
    "from_name string, from_addr string, subject string, summary string, action_req string, "
    "deadline string, tone string, in_scope boolean, llm_status string, raw_path string"
)
START = datetime(2026, 6, 1)


def message(uid, received, processed=datetime(2026, 1, 1), mailbox="a"):
    return (mailbox, 1, uid, received, processed, None, "x@y", "s", "t", None, None, None, True,
            "ok", f"/{uid}.eml")


def test_second_truncation_keeps_types(spark):
    df = spark.sql(
        "select timestamp'2026-01-01 00:00:01.999999' a, timestamp_ntz'1969-12-31 23:59:59.5' b"
    ).select(timing.utc_second("a").alias("a"), timing.utc_second("b").alias("b"))
    assert [f.dataType.simpleString() for f in df.schema] == ["timestamp", "timestamp_ntz"]
    r = df.selectExpr("cast(a as string) a", "cast(b as string) b").first()
    assert (r.a, r.b) == ("2026-01-01 00:00:01", "1969-12-31 23:59:59")


def test_half_open_window_and_marks(spark):
    end = START + timedelta(days=7)
    edge = timedelta(seconds=1)
    df = spark.createDataFrame(
        [message(1, START - edge), message(2, START), message(3, end - edge), message(4, end)], ROW
    )
    got = dg.pending(df, F.lit(START), F.lit(end))
    assert sorted(r.uid for r in got.collect()) == [2, 3]
    windows = spark.createDataFrame(
        [("a", START, end)], "mailbox string, window_start timestamp, window_end timestamp"
    )
    assigned = dg.assign_windows(df, windows)
    items = dg.mark_digested(assigned)
    ledger = dg.ledger_rows(windows, assigned)
    assert ledger.first().email_count == 2
    late = items.withColumn("digested_at", F.lit(datetime(2027, 1, 1)))
    marks = dg.completed_marks(items.unionByName(late), ledger)
    assert {r.digested_at for r in marks.collect()} == {end}
    assert dg.pending(df, F.lit(START), F.lit(end), marks).count() == 0
    unfinished = dg.completed_marks(items, ledger.limit(0))
    assert dg.pending(df, F.lit(START), F.lit(end), unfinished).count() == 2


def test_window_bounds_follow_the_local_calendar(spark):
    boxes = spark.createDataFrame([("new",), ("old",)], "mailbox string")
    ledger = spark.createDataFrame(
        [("old", datetime(2026, 3, 1)), ("old", datetime(2026, 3, 2, 13))],
        "mailbox string, window_end timestamp",
    )
    # 2026-03-09 08:00 in Toronto is 12:00 UTC; a week before, before the clock change, 13:00.
    end = F.lit(datetime(2026, 3, 9, 12)).cast("timestamp")
    got = {r.mailbox: (r.window_start, r.window_end)
           for r in dg.window_bounds(boxes, ledger, end, "America/Toronto").collect()}
    assert got["new"] == (datetime(2026, 3, 2, 13), datetime(2026, 3, 9, 12))
    assert got["old"] == (datetime(2026, 3, 2, 13), datetime(2026, 3, 9, 12))
    weeks = spark.sql(
        "select explode(array(timestamp'2026-03-09 11:59:59', timestamp'2026-03-09 12:00:00')) t"
    ).select(timing.week_start("t").alias("s"), timing.next_week_start("t").alias("e"))
    assert [tuple(r) for r in weeks.collect()] == [
        (datetime(2026, 3, 2, 13), datetime(2026, 3, 9, 12)),
        (datetime(2026, 3, 9, 12), datetime(2026, 3, 16, 12)),
    ]


def test_chain_assignment_and_stranded_mail(spark):
    day = timedelta(days=1)
    runs = spark.createDataFrame(
        [("a", START), ("a", START + 7 * day), ("a", START + 21 * day), ("b", START)],
        "mailbox string, run_at timestamp",
    )
    windows = dg.window_chain(runs, "UTC")
    assert windows.count() == 4
    rows = [
        message(1, START - 8 * day), message(2, START - 7 * day), message(3, START),
        message(4, START + 20 * day), message(5, START + 21 * day),
        message(6, START + day, START + 8 * day), message(7, START, mailbox="c"),
        message(8, START - day, mailbox="b"),
    ]
    got = {r.uid: (r.window_end, r.stranded)
           for r in dg.audit_windows(spark.createDataFrame(rows, ROW), windows).collect()}
    assert got == {
        1: (None, True), 2: (START, False), 3: (START + 7 * day, False),
        4: (START + 21 * day, False), 5: (None, False), 6: (None, True), 7: (None, False),
        8: (START, False),
    }


def clock_change(spark):
    """Three cards out of order in a window over the end of summer time, and a mailbox without mail."""
    rows = [
        ("a", 3, 70, datetime(2025, 11, 3, 2, 15), datetime(2025, 11, 4), "Ferry", "piers@ferry.example", "Timetable",
         "The late ferry is cancelled.", "fyi", None, "neutral", False, "ok", "a/70.eml"),
        ("a", 3, 12, datetime(2025, 11, 2, 4, 5), datetime(2025, 11, 4), None, "gauge@river.example", None,
         None, None, None, None, True, "error", "a/12.eml"),
        ("a", 3, 44, datetime(2025, 10, 29, 20, 0), datetime(2025, 11, 4), "Ana & Co", None, "Roof: \"leak\"",
         "Ana asks for a visit.", "action", "2025-11-20", "heated", False, "ok", "a/44.eml"),
    ]
    windows = spark.createDataFrame(
        [(box, datetime(2025, 10, 29, 13, 45), datetime(2025, 11, 5, 14, 45)) for box in ("a", "b")],
        "mailbox string, window_start timestamp, window_end timestamp",
    )
    return spark.createDataFrame(rows, ROW), windows


def test_text_document(spark):
    df, windows = clock_change(spark)
    cards = dg.digest_cards(dg.assign_windows(df, windows), "America/Toronto")
    pages = dg.digest_text(windows, cards, "America/Toronto").collect()
    text = {r.mailbox: r.text for r in pages}
    assert len(pages) == 2
    head = "Weekly email digest\nOct 29, 2025 09:45 EDT to Nov 5, 2025 09:45 EST\n"
    assert text["a"] == head + (
        "\n---\n"
        "Oct 29, 2025 16:00 | Ana & Co <>\n"
        "Roof: \"leak\"\n"
        "Ana asks for a visit.\n"
        "Action: action | Deadline: 2025-11-20 | Tone: heated | Out of scope\n"
        "Original: a/44.eml\n"
        "\n---\n"
        "Nov 2, 2025 00:05 | gauge@river.example\n"
        "(no subject)\n"
        "could not summarize - read original\n"
        "Action: none | Tone: neutral | Summary error\n"
        "Original: a/12.eml\n"
        "\n---\n"
        "Nov 2, 2025 21:15 | Ferry <piers@ferry.example>\n"
        "Timetable\n"
        "The late ferry is cancelled.\n"
        "Action: fyi | Tone: neutral | Out of scope\n"
        "Original: a/70.eml\n"
    )
    assert text["b"] == head + "\nNo messages were received during this period.\n"


def test_card_defaults(spark):
    row = ("a", 1, 1, START, START, None, None, "  ", None, None, None, None, True, "ok", None)
    card = dg.digest_cards(spark.createDataFrame([row], ROW), "UTC").first()
    assert (card.card_from, card.card_subject, card.card_summary, card.card_action,
            card.card_deadline, card.card_tone) == (
        "(unknown sender)", "(no subject)", "could not summarize - read original", "none", "",
        "neutral")
    assert (card.is_heated, card.is_error, card.is_out_of_scope) == (False, False, False)


@pytest.mark.parametrize("page_size", [1, 7, 1000])
def test_pages_join_to_the_document(spark, page_size):
    # Many rows in one second, in one minute, over several uid cells.
    rows = [
        message(uid * 40_000, START + timedelta(seconds=(uid * 7) % 5 * 30)) for uid in range(40)
    ]
    windows = spark.createDataFrame(
        [("a", START, START + timedelta(days=7))],
        "mailbox string, window_start timestamp, window_end timestamp",
    )
    cards = dg.digest_cards(dg.assign_windows(spark.createDataFrame(rows, ROW), windows), "UTC")
    pages = dg.digest_text(windows, cards, "UTC", page_size).orderBy("page").collect()
    text = "".join(p.text for p in pages)
    want = [f"/{r[2]}.eml" for r in sorted(rows, key=lambda r: (r[3], r[1], r[2]))]
    assert [line[10:] for line in text.split("\n") if line.startswith("Original: ")] == want
    assert [p.page for p in pages] == list(range(-(-40 // page_size)))
    assert text.startswith("Weekly email digest\nJun 1, 2026 00:00 UTC to Jun 8, 2026 00:00 UTC\n\n---\n")


def test_zone_names_of_each_bound(spark):
    windows = spark.createDataFrame(
        [("a", datetime(2025, 3, 3, 13), datetime(2025, 3, 10, 12)),
         ("b", datetime(2025, 10, 27, 12), datetime(2025, 11, 3, 13))],
        "mailbox string, window_start timestamp, window_end timestamp",
    )
    df, _ = clock_change(spark)
    cards = dg.digest_cards(dg.assign_windows(df.limit(0), windows), "America/Toronto")
    text = {r.mailbox: r.text for r in dg.digest_text(windows, cards, "America/Toronto").collect()}
    assert "Mar 3, 2025 08:00 EST to Mar 10, 2025 08:00 EDT" in text["a"]
    assert "Oct 27, 2025 08:00 EDT to Nov 3, 2025 08:00 EST" in text["b"]


def test_mail_of_the_runs_own_second_is_in_its_digest(spark):
    df, windows = clock_change(spark)
    now = windows.where("mailbox = 'a'").first().window_end
    late = df.limit(1).withColumn("processed_at", F.lit(now).cast("timestamp"))
    assert dg.assign_windows(late, windows).count() == 1
    later = df.limit(1).withColumn("processed_at", F.lit(now + timedelta(seconds=9)).cast("timestamp"))
    assert dg.assign_windows(later, windows).count() == 0
    assert dg.assign_windows(later, windows, as_of_run=False).count() == 1
