"""The index of stored keys: lookups against plain joins, and what they open."""

import pytest
from plans import files_read

from mailframe.sources import key_index
from mailframe.sources.key_index import KeyIndex
from mailframe.sources.tables import MailTables

ROW = "mailbox string, uid_validity long, uid long, message_id string, received_month string"


def stored(spark, ids, month="2025-03"):
    rows = [("in", 1, i, f"m{i}" if i % 4 else None, month) for i in ids]
    return spark.createDataFrame(rows, ROW)


def found(index, batch):
    return sorted(r.uid for r in index.matching(batch).collect())


def batch_of(spark, *rows):
    return spark.createDataFrame(rows, "mailbox string, uid_validity long, uid long, message_id string")


def test_row_keys_and_ids_are_found(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), buckets=16)
    assert index.matching(batch_of(spark, ("in", 1, 1, "m1"))) is None
    index.add(stored(spark, range(200)))
    batch = batch_of(
        spark, ("in", 1, 5, "other"), ("in", 2, 6, None), ("in", 1, 999, "m7"), ("in", 1, 998, "m8"),
        ("out", 1, 9, "m9"), ("in", 1, 12, ""), ("in", 1, 13, "m14"),
    )
    # Row keys 5, 12 and 13, ids m7 and m14; m8 was stored without its id, and "out" is another mailbox.
    assert found(index, batch) == [5, 7, 12, 13, 14]


def test_few_files_are_opened_for_a_small_batch(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), buckets=64)
    index.add(stored(spark, range(5_000)))
    index.add(stored(spark, range(5_000, 10_000)))
    batch = batch_of(spark, *(("in", 1, 20_000 + i, f"n{i}") for i in range(99)), ("in", 1, 7_001, "new"))
    result = index.matching(batch)
    assert [r.uid for r in result.collect()] == [7_001]
    total = sum(1 for _ in tmp_path.glob("*/keys/bucket=*/*.parquet"))
    assert total == 128
    # One hit and a false alarm for one key in a hundred; the other file is the list of candidates.
    assert files_read(index.matching(batch)) < 12


def test_generations_merge_and_stay_complete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "GENERATIONS", 2)
    index = KeyIndex(spark, str(tmp_path), buckets=4)
    for start in (0, 40, 50, 60, 65):
        index.add(stored(spark, range(start, start + 10)))
    index.add(stored(spark, []))
    assert len(index.generations()) <= 2
    assert sum(g.n for g in index.generations()) == sum(1 + bool(i % 4) for s in (0, 40, 50, 60, 65) for i in range(s, s + 10))
    assert found(index, batch_of(spark, *(("in", 1, i, None) for i in range(100)))) == sorted(
        {*range(10), *range(40, 75)}
    )


def test_many_blocks_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "KEYS_PER_BITMAP", 50)
    monkeypatch.setattr(key_index, "KEYS_PER_FILE", 100)
    index = KeyIndex(spark, str(tmp_path), buckets=2)
    index.add(stored(spark, range(1000)))
    assert index.generations()[0].blocks > 10
    wanted = range(0, 2000, 3)
    assert found(index, batch_of(spark, *(("in", 1, i, None) for i in wanted))) == [i for i in wanted if i < 1000]
    absent = batch_of(spark, *(("in", 1, i, None) for i in range(5_000, 9_000)))
    # Far fewer than all: a bitmap of few keys rules out nearly everything.
    assert index.candidates(absent).count() < 40


def test_an_id_of_a_third_of_the_batch_is_asked_once(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), buckets=4)
    index.add(stored(spark, range(10)))
    batch = batch_of(spark, *(("in", 1, 100 + i, "m3") for i in range(300)))
    assert index.candidates(batch).where("kind = 'id'").count() == 1
    assert found(index, batch) == [3]


@pytest.fixture
def tables(spark, tmp_path):
    return MailTables(spark, str(tmp_path / "store"))


def message(spark, *rows):
    return spark.createDataFrame(rows, "mailbox string, uid_validity long, uid long, message_id string, at string").selectExpr(
        "mailbox", "uid_validity", "uid", "message_id", "cast(at as timestamp) as received_at",
        *(f"cast(null as string) as {c}" for c in (
            "from_name", "from_addr", "subject", "raw_path", "summary", "action_req", "deadline", "tone", "llm_status", "llm_error",
        )),
        "true as in_scope", "cast(at as timestamp) as processed_at",
    )


def like(tables, batch):
    return sorted(r.uid for r in tables.messages_like(batch).collect())


def test_messages_like_a_batch(spark, tables):
    batch = batch_of(spark, ("in", 1, 1, None), ("in", 1, 9, "b"), ("in", 1, 3, None))
    assert like(tables, batch) == []
    tables.append_messages(message(spark, ("in", 1, 1, "a", "2025-01-05 00:00:00"), ("in", 1, 2, "b", "2025-02-05 00:00:00")))
    tables.append_messages(message(spark, ("in", 1, 3, None, None), ("in", 1, 4, "d", "2025-02-06 00:00:00")))
    assert like(tables, batch) == [1, 2, 3]


def test_an_entry_without_its_message_counts_for_nothing(spark, tables):
    tables.append_messages(message(spark, ("in", 1, 1, "a", "2025-01-05 00:00:00")))
    # A run that died after the index and before the messages.
    tables.known.add(stored(spark, [7], "2025-01"))
    assert like(tables, batch_of(spark, ("in", 1, 7, None), ("in", 1, 1, None))) == [1]


def test_a_store_from_before_the_index_is_indexed_whole(spark, tables):
    old = message(spark, ("in", 1, 1, "a", "2025-01-05 00:00:00"))
    tables.append_messages(old)
    plain = MailTables(spark, tables.root + "-plain")
    tables.messages().write.partitionBy("received_month").parquet(f"{plain.root}/messages")
    batch = batch_of(spark, ("in", 1, 1, None))
    assert like(plain, batch) == [1]
    plain.append_messages(message(spark, ("in", 1, 2, "b", "2025-01-06 00:00:00")))
    assert like(plain, batch) == [1]
