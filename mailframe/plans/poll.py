"""One poll: new mail of all mailboxes to stored, summarised messages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.text import empty_to_null, format_address
from mailframe.functions.timing import received_at, to_local, utc_second
from mailframe.operators.archive import archive_month, archive_paths, new_archive_rows
from mailframe.operators.incremental import (
    advance_cursors,
    baseline,
    batch_moves,
    insert_absent,
    new_since,
    uids_are_unique,
)
from mailframe.operators.model import ClientFactory, build_prompt, pick_attempt, summarize
from mailframe.operators.scope import batch_counts, flag_scope, route_outcome
from mailframe.schemas import MESSAGE_KEY, MESSAGES
from mailframe.session import stage
from mailframe.sources.corpus import parse_mail
from mailframe.sources.tables import MailTables


@dataclass(frozen=True)
class PollSettings:
    """What a poll needs besides its data; ``parse`` and ``prompt`` can be replaced."""

    factory: ClientFactory
    allowlist: list[str] | DataFrame | None = None
    language: str = "fr"
    body_limit: int = fixed.BODY_CHAR_LIMIT
    timeout: float = fixed.MODEL_TIMEOUT_SECONDS
    parallelism: int | None = None
    in_flight: int = 1
    zone: str = fixed.DEFAULT_ZONE
    parse: Callable[..., DataFrame] = parse_mail
    prompt: Callable[..., DataFrame] = build_prompt


def process_batch(
    tables: MailTables,
    raw: DataFrame,
    settings: PollSettings,
    now: datetime | None = None,
    resets: DataFrame | None = None,
) -> DataFrame:
    """Store one batch of raw mail and move the cursors; returns the counters per mailbox.

    The order of the writes is the contract: archive, messages, cursors. Whatever fails before
    the last one is read again, found in the tables and not stored twice.
    """
    now = now or datetime.now(timezone.utc)
    cursors = tables.cursors()
    hashed = raw.select(*MESSAGE_KEY, "raw").withColumn("sha", F.sha2("raw", 256))
    processed = F.lit(now).cast("timestamp")
    # Read the containers once; everything below starts from this table.
    batch = stage(
        settings.parse(hashed, "raw", settings.body_limit)
        .withColumn("processed_at", utc_second(processed))
        .withColumn("received_at", received_at("sent_at", "processed_at"))
        .withColumn(
            "received_local",
            F.coalesce("sent_local", to_local("processed_at", settings.zone)),
        ),
        "batch",
    )

    archived = tables.archive(archive_months(batch))
    paths = stage(
        archive_paths(
            batch.select(*MESSAGE_KEY, "message_id", "received_local", "sha"),
            archived,
            prefix="mailbox",
        ),
        "paths",
    )
    tables.append_archive(new_archive_rows(paths, raw, archived))

    asked = batch.select(*MESSAGE_KEY, empty_to_null("message_id").alias("message_id"))
    known = stage(tables.messages_like(asked), "known")
    fresh = stage(flag_scope(fresh_rows(batch, known), settings.allowlist), "fresh")
    # Catalyst does not move filters through a Python map: only these rows may reach the model.
    asked = fresh.where("parse_error is null and in_scope").withColumn(
        "from_display", format_address("from_name", "from_addr")
    )
    answers = pick_attempt(
        summarize(
            asked,
            settings.factory,
            MESSAGE_KEY,
            settings.language,
            settings.timeout,
            settings.parallelism,
            settings.prompt,
            settings.in_flight,
        )
    ).select(*MESSAGE_KEY, "model")
    located = paths.select(*MESSAGE_KEY, "sha", "raw_path").distinct()
    # Bodies have been asked about; only the columns of the message table go into these joins.
    stored = stage(
        route_outcome(fresh.join(answers, MESSAGE_KEY, "left"))
        .join(located, [*MESSAGE_KEY, "sha"])
        .withColumns({c: empty_to_null(c) for c in ("from_name", "from_addr", "subject")})
        .select(*(c for c in MESSAGES.names if c != "received_month")),
        "stored",
    )
    tables.append_messages(stored)

    moved = advance_cursors(cursors, resets, batch_moves(batch))
    tables.write_cursors(moved, tables.next_cursor_version())
    return batch_counts(batch, stored)


def archive_months(batch: DataFrame) -> DataFrame:
    """The archive months (``YYYY/MM``) of a batch, as a staged table of its own."""
    return stage(batch.select(archive_month("received_local").alias("of")).distinct(), "months")


def fresh_rows(batch: DataFrame, messages: DataFrame) -> DataFrame:
    """The rows of ``batch`` to store.

    Decided on the keys alone. What is dropped is written as a table of keys, and as it is mostly
    small, Spark then removes it from the batch by a broadcast: the bodies are not shuffled. A
    batch that repeats uids needs whole rows to tell its copies apart.
    """
    batch = batch.withColumn("message_id", empty_to_null("message_id"))
    if not uids_are_unique(batch):
        return insert_absent(batch, messages)
    keys = batch.select(*MESSAGE_KEY, "message_id")
    kept = insert_absent(keys, messages, unique_uids=True)
    dropped = stage(
        keys.select(*MESSAGE_KEY).join(kept, MESSAGE_KEY, "left_anti"), "dropped"
    )
    return batch.join(dropped, MESSAGE_KEY, "left_anti")


def poll(
    tables: MailTables,
    raw: DataFrame | None,
    mailbox_state: DataFrame,
    settings: PollSettings,
    now: datetime | None = None,
) -> DataFrame:
    """Process what is new since the cursors; first-time and reset mailboxes only get a cursor.

    Without ``raw`` the mail comes from the log of the store.
    """
    cursors = tables.cursors()
    started = stage(baseline(mailbox_state, cursors), "baseline")
    resets = started.where("initialized")
    new = tables.raw_since(cursors, mailbox_state) if raw is None else new_since(raw, cursors, mailbox_state)
    counts = process_batch(tables, new, settings, now, resets)
    flags = started.select("mailbox", "initialized")
    return flags.join(counts, "mailbox", "left").na.fill(0)
