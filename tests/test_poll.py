import json
import time
from datetime import datetime

import pytest

from mailframe import schemas
from mailframe.operators.model import pick_attempt, summarize
from mailframe.plans import poll as poll_plan
from mailframe.plans.poll import PollSettings, poll
from mailframe.plans.weekly import run_digest
from mailframe.session import stage
from mailframe.sources.tables import MailTables
from mailframe.streaming.ingest import ingest_stream

GOOD = '{"summary":"ok then","action_required":"reply","deadline":"2026-06-05","tone":"neutral"}'


def mail(uid, message_id, sender="desk@lending.example", body="Bonjour", date="Tue, 2 Jun 2026 10:00:00 -0400",
         mailbox="a", validity=8):
    text = f"From: Board <{sender}>\nSubject: s{uid}\nDate: {date}\n"
    if message_id:
        text += f"Message-Id: <{message_id}>\n"
    return (mailbox, validity, uid, f"{text}\n{body}\n".encode())


def scripted():
    """Answers by what the body asks for; a second, strict call can differ."""

    def client(system, user, timeout):
        body = user.split("\n\n", 1)[1].strip()
        strict = "nothing else" in system
        if body == "raise" or (body == "raise-once" and not strict):
            raise RuntimeError("no connection")
        if body == "slow":
            time.sleep(5)
        if body == "bad" or (body == "bad-once" and not strict):
            return "not json"
        if body == "empty":
            return ""
        return GOOD

    return client


def test_attempts(spark):
    bodies = ["good", "bad", "bad-once", "raise", "raise-once", "empty", "slow", "good"]
    df = spark.createDataFrame(
        [(i, "x", "s", b) for i, b in enumerate(bodies)],
        "i long, from_display string, subject string, body_text string",
    ).coalesce(1)
    out = pick_attempt(summarize(df, scripted, ["i"], timeout=1.0)).orderBy("i").collect()
    got = [(r.model.text, r.model.status, r.model.err, r.retried) for r in out]
    failed = "could not summarize"
    assert got == [
        ("ok then", "ok", None, False),
        (failed, "error", "validation failed after retry", True),
        ("ok then", "ok", None, True),
        (failed, "error", "no connection", True),
        ("ok then", "ok", None, True),
        (failed, "error", "validation failed after retry", True),
        (failed, "error", "time limit exceeded", True),
        ("ok then", "ok", None, False),
    ]
    assert out[6].latency_ms >= 1000 and out[1].raw_response == "not json"


@pytest.fixture
def tables(spark, tmp_path):
    return MailTables(spark, str(tmp_path / "store"))


def raw_of(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_MAIL)


def state_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.MAILBOX_STATE)


def test_polls_and_digest(spark, tables):
    settings = PollSettings(scripted, allowlist=["DESK@lending.example"], zone="UTC")
    now = datetime(2026, 6, 3)
    old = [mail(100, "old")]
    first = poll(tables, raw_of(spark, old), state_of(spark, ("a", 8, 101)), settings, now)
    assert [tuple(r) for r in first.collect()] == [("a", True, 0, 0, 0, 0, 0)]
    assert tables.messages().count() == 0
    assert [tuple(r) for r in tables.cursors().collect()] == [("a", 8, 100)]

    new = old + [
        mail(101, "m1"), mail(102, "m1", body="again"), mail(103, "m3", "other@x.y"),
        mail(104, None, body="bad"), mail(105, None), ("a", 8, 106, b""),
        mail(107, "late", date="Tue, 5 May 2026 10:00:00 -0400"),
    ]
    counts = poll(tables, raw_of(spark, new), state_of(spark, ("a", 8, 108)), settings, now)
    assert [tuple(r) for r in counts.collect()] == [("a", False, 7, 6, 1, 2, 1)]
    got = {r.uid: r for r in tables.messages().collect()}
    assert sorted(got) == [101, 103, 104, 105, 106, 107]
    assert (got[101].summary, got[101].action_req, got[101].deadline) == ("ok then", "reply", "2026-06-05")
    assert got[101].raw_path == "a/2026/06/m1.eml" and got[101].message_id == "m1"
    assert got[103].summary == "out of scope - not summarized" and not got[103].in_scope
    assert (got[104].llm_status, got[104].message_id) == ("error", None)
    assert got[106].llm_error.startswith("parse message: ") and got[106].in_scope
    assert got[106].received_at == now and got[106].raw_path == "a/2026/06/uid-106.eml"
    # Duplicates are archived as well, under a name of their own.
    assert tables.archive().count() == 7
    assert [tuple(r) for r in tables.cursors().collect()] == [("a", 8, 107)]

    # Nothing new; then the cursor is lost and everything is found to be known.
    again = poll(tables, raw_of(spark, new), state_of(spark, ("a", 8, 108)), settings, now)
    assert [tuple(r) for r in again.collect()] == [("a", False, 0, 0, 0, 0, 0)]
    tables.write_cursors(spark.createDataFrame([("a", 8, 100)], schemas.CURSORS), tables.next_cursor_version())
    redo = poll(tables, raw_of(spark, new), state_of(spark, ("a", 8, 108)), settings, now)
    assert [tuple(r) for r in redo.collect()] == [("a", False, 7, 0, 7, 0, 0)]
    assert tables.messages().count() == 6 and tables.archive().count() == 7

    def broken(pages):
        raise RuntimeError("mail server down")

    end = datetime(2026, 6, 8)
    with pytest.raises(RuntimeError):
        run_digest(tables, broken, end, "UTC")
    sent = []
    ledger = run_digest(tables, lambda pages: sent.extend(pages.collect()), end, "UTC").collect()
    assert [(r.email_count, r.window_start) for r in ledger] == [(5, datetime(2026, 6, 1))]
    assert sent[0].text.count("\n---\n") == 5 and "Subject" not in sent[0].text
    # The next week is empty and still recorded; late mail is never digested.
    later = run_digest(tables, lambda pages: sent.extend(pages.collect()), datetime(2026, 6, 15), "UTC")
    assert [(r.email_count, r.window_start) for r in later.collect()] == [(0, end)]
    assert "No messages were received" in sent[1].text
    assert tables.digests().count() == 2


def test_bodies_do_not_join_the_answers(spark, tables, monkeypatch):
    """What is stored of a message has no body, so that its joins move and write none."""
    staged = {}
    monkeypatch.setattr(poll_plan, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    tables.write_cursors(spark.createDataFrame([("a", 8, 0)], schemas.CURSORS), 0)
    poll(tables, raw_of(spark, [mail(1, "m1"), mail(2, None, body="bad")]), state_of(spark, ("a", 8, 3)), PollSettings(scripted))
    assert "body_text" in staged["fresh"].columns
    assert set(staged["stored"].columns) == set(schemas.MESSAGES.names) - {"received_month"}
    assert sorted((r.uid, r.llm_status) for r in tables.messages().collect()) == [(1, "ok"), (2, "error")]


def test_changed_epoch_only_moves_the_cursor(spark, tables):
    tables.write_cursors(spark.createDataFrame([("a", 7, 99)], schemas.CURSORS), 0)
    raw = raw_of(spark, [mail(20, "x")])
    counts = poll(tables, raw, state_of(spark, ("a", 8, 40)), PollSettings(scripted)).collect()
    assert counts[0].initialized and counts[0].fetched == 0
    assert [tuple(r) for r in tables.cursors().collect()] == [("a", 8, 39)]


def test_stream_resumes_and_finds_known_mail(spark, tables, tmp_path):
    source_dir = str(tmp_path / "incoming")
    checkpoint = str(tmp_path / "checkpoint")
    baselines = spark.createDataFrame([("a", 8, 1)], schemas.CURSORS)
    settings = PollSettings(scripted)
    seen = []

    def run():
        stream = spark.readStream.schema(schemas.RAW_MAIL).parquet(source_dir)
        ingest_stream(
            stream, tables, checkpoint, settings, baselines,
            lambda counts, i: seen.extend((r.fetched, r.duplicates) for r in counts.collect()),
        ).awaitTermination(120)

    raw_of(spark, [mail(1, "backlog"), mail(3, "m3"), mail(2, "m2")]).coalesce(1).write.parquet(source_dir)
    run()
    # A repeated delivery of uid 3, a copy of its id, and one new message with a smaller uid gap.
    raw_of(spark, [mail(3, "m3"), mail(9, "m3"), mail(5, "m5")]).coalesce(1).write.mode("append").parquet(source_dir)
    run()
    assert seen == [(2, 0), (3, 2)]
    assert sorted(r.uid for r in tables.messages().collect()) == [2, 3, 5]
    assert [tuple(r) for r in tables.cursors().collect()] == [("a", 8, 9)]
