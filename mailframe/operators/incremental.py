"""Cursors, epoch resets, and the test against what is already stored."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.operators.dedupe import dedupe_two_keys
from mailframe.schemas import MESSAGE_KEY


def baseline(mailbox_state: DataFrame, cursors: DataFrame) -> DataFrame:
    """One row per mailbox: its cursor, and whether this run only initialises it.

    A mailbox without a cursor, or one whose epoch changed, starts at the newest uid: the backlog
    is skipped.
    """
    known = cursors.select(
        "mailbox", F.col("uid_validity").alias("_known"), F.col("last_uid").alias("_last")
    )
    joined = mailbox_state.join(known, "mailbox", "left")
    first = (F.coalesce("_known", F.lit(0)) == 0) | (F.col("_known") != F.col("uid_validity"))
    newest = F.greatest(F.col("uid_next") - 1, F.lit(0)).cast("bigint")
    return joined.select(
        "mailbox",
        "uid_validity",
        F.when(first, newest).otherwise(F.col("_last")).alias("last_uid"),
        first.alias("initialized"),
    )


def live_cursors(cursors: DataFrame, mailbox_state: DataFrame | None = None) -> DataFrame:
    """(mailbox, uid_validity, last_uid) of the mailboxes that can have new mail.

    With ``mailbox_state``, a mailbox whose epoch moved on has none (see ``baseline``).
    """
    live = cursors.where((F.col("uid_validity") != 0) & (F.col("last_uid") < fixed.MAX_UID))
    if mailbox_state is not None:
        live = live.join(mailbox_state, ["mailbox", "uid_validity"], "left_semi")
    return live.select("mailbox", "uid_validity", "last_uid")


def above(raw: DataFrame, live: DataFrame) -> DataFrame:
    """The rows above their mailbox's live cursor. Spark broadcasts cursors if they are small."""
    return raw.join(live, ["mailbox", "uid_validity"]).where("uid > last_uid").drop("last_uid")


def new_since(
    raw: DataFrame, cursors: DataFrame, mailbox_state: DataFrame | None = None
) -> DataFrame:
    """Rows above their mailbox's cursor in the cursor's epoch.

    With ``mailbox_state``, a mailbox whose epoch moved on gives no rows (see ``baseline``). The
    lowest live cursor is a scalar subquery, whose value Spark hands to the scan of the raw mail at
    any number of mailboxes; the join is the exact test. Spark splits a hot mailbox when it has to
    shuffle. A log in ``MailTables`` has bounds for every bucket of mailboxes instead.
    """
    live = live_cursors(cursors, mailbox_state)
    lowest = live.agg(F.min("last_uid")).scalar()
    return above(raw.where(F.col("uid") > lowest), live)


def batch_moves(batch: DataFrame) -> DataFrame:
    """The cursor moves of one batch; duplicates move the cursor too."""
    return batch.groupBy("mailbox", "uid_validity").agg(F.max("uid").alias("last_uid"))


def advance_cursors(
    cursors: DataFrame, resets: DataFrame | None = None, moves: DataFrame | None = None
) -> DataFrame:
    """The cursor table after a run: ``resets`` replace a cursor, ``moves`` only raise it.

    A move counts inside the epoch of its mailbox's cursor, however late and in whatever order its
    batch arrives; an epoch changes by a reset alone. A mailbox without a cursor starts at the
    highest move of its newest epoch.
    """
    key = ["mailbox", "uid_validity", "last_uid"]
    current = cursors.select(*key)
    if resets is not None:
        ranked = current.withColumn("_rank", F.lit(0)).unionByName(
            resets.select(*key).withColumn("_rank", F.lit(1))
        )
        current = _newest(ranked, "_rank", "uid_validity", "last_uid")
    if moves is None:
        return current
    known = current.withColumnsRenamed({"uid_validity": "_epoch", "last_uid": "_uid"})
    moved = moves.select(*key).join(known, "mailbox", "full")
    raised = moved.where("_epoch is null or uid_validity = _epoch").select(
        "mailbox", "uid_validity", F.greatest("last_uid", "_uid").alias("last_uid")
    )
    return _newest(raised.unionByName(current), "uid_validity", "last_uid")


def _newest(rows: DataFrame, *order: str) -> DataFrame:
    """One cursor per mailbox, the greatest by ``order``."""
    best = rows.groupBy("mailbox").agg(F.max(F.struct(*order)).alias("_c"))
    return best.select("mailbox", "_c.uid_validity", "_c.last_uid")


def known_keys(batch: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored row keys and message ids that ``batch`` also has.

    The history is read for its key columns only and reduced by semi joins to at most the size of
    the batch, before anything of the batch moves. Batch ids are made distinct first, so an id
    shared by a third of the batch counts once.
    """
    ids = ["mailbox", "message_id"]
    rows = messages.select(*MESSAGE_KEY).join(batch.select(*MESSAGE_KEY), MESSAGE_KEY, "left_semi")
    batch_ids = batch.select(*ids).where("message_id <> ''").distinct()
    with_id = messages.select(*ids).where("message_id is not null")
    return rows, with_id.join(batch_ids, ids, "left_semi")


def unknown_only(batch: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows of ``batch`` that share neither the row key nor a message id with ``messages``.

    Two equi anti joins: NOT (a OR b) is NOT a AND NOT b, while one join on the OR would compare
    every pair. A row without a message id never matches on it; such rows get a second join key
    that spreads them over the shuffle.
    """
    rows, ids = known_keys(batch, messages)
    spread = F.when(F.col("message_id").isNull() | (F.col("message_id") == ""), F.col("uid"))
    return (
        batch.join(rows, MESSAGE_KEY, "left_anti")
        .withColumn("_spread", F.coalesce(spread, F.lit(0)))
        .join(
            ids.withColumn("_spread", F.lit(0).cast("bigint")),
            ["mailbox", "message_id", "_spread"],
            "left_anti",
        )
        .drop("_spread")
    )


def insert_absent(
    batch: DataFrame, messages: DataFrame, unique_uids: bool = False
) -> DataFrame:
    """The rows that inserting ``batch`` in uid order would add to ``messages``."""
    return dedupe_two_keys(
        unknown_only(batch, messages),
        order=["mailbox", "uid_validity", "uid"],
        key_a=MESSAGE_KEY,
        key_b=["mailbox", "message_id"],
        unique_a=unique_uids,
    )


def uids_are_unique(batch: DataFrame) -> bool:
    """Measured, not assumed: whether every (mailbox, epoch, uid) occurs once in the batch."""
    repeats = batch.groupBy(*MESSAGE_KEY).agg(F.count("*").alias("_n")).where("_n > 1")
    return repeats.isEmpty()
