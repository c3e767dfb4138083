"""The raw log in folders: bounds per bucket of mailboxes."""

import pytest
from plans import files_read

from mailframe.sources.tables import MailTables

RAW = "mailbox string, uid_validity long, uid long, raw binary"
CURSORS = "mailbox string, uid_validity long, last_uid long"


@pytest.fixture
def tables(spark, tmp_path):
    made = MailTables(spark, str(tmp_path / "store"), box_buckets=32, uid_block=10)
    rows = [(f"box{b}", 1, uid, bytearray(b"x")) for b in range(6) for uid in range(100)]
    made.append_raw(spark.createDataFrame(rows, RAW).repartition(1))
    return made


def new(tables, spark, cursors, state=None):
    return tables.raw_since(spark.createDataFrame(cursors, CURSORS), state)


def test_rows_above_the_cursors(spark, tables):
    got = new(tables, spark, [("box0", 1, 97), ("box1", 1, 89), ("box2", 2, 0), ("box3", 1, 99), ("none", 1, 5)])
    assert sorted((r.mailbox, r.uid) for r in got.collect()) == [("box0", 98), ("box0", 99)] + [("box1", u) for u in range(90, 100)]
    assert new(tables, spark, []).collect() == []
    state = spark.createDataFrame([("box0", 2, 7), ("box1", 1, 100)], "mailbox string, uid_validity long, uid_next long")
    assert {r.mailbox for r in new(tables, spark, [("box0", 1, 97), ("box1", 1, 97)], state).collect()} == {"box1"}


def test_an_idle_mailbox_widens_its_own_bucket_only(spark, tables):
    recent = [(f"box{b}", 1, 95) for b in range(5)]
    few = files_read(new(tables, spark, recent))
    # One folder for each mailbox that is up to date, ten for the idle one.
    assert few == 5
    assert files_read(new(tables, spark, [*recent, ("box5", 1, -1)])) == 15


def test_an_empty_store(spark, tmp_path):
    assert new(MailTables(spark, str(tmp_path)), spark, [("a", 1, 0)]).collect() == []
