"""One digest run: pending messages to delivered documents and the ledger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.operators.digest import (
    assign_windows,
    completed_marks,
    digest_cards,
    digest_text,
    ledger_rows,
    mark_digested,
    window_bounds,
)
from mailframe.schemas import MESSAGE_KEY
from mailframe.session import stage
from mailframe.sources.tables import MailTables


def pending_rows(tables: MailTables, windows: DataFrame) -> DataFrame:
    """Undigested messages with the window of their mailbox.

    The outermost bounds become literals, so that only the months of these windows are read, of
    the messages and of the marks.
    """
    low, high = windows.agg(F.min("window_start"), F.max("window_end")).first()
    if low is None:
        low = high = datetime.now(timezone.utc)
    low, high = F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")
    months = F.col("received_month").between(
        F.date_format(low, "yyyy-MM"), F.date_format(high, "yyyy-MM")
    )
    messages = tables.messages().where(
        months & (F.col("received_at") >= low) & (F.col("received_at") < high)
    )
    marks = completed_marks(tables.digest_items().where(months), tables.digests())
    return assign_windows(messages, windows, as_of_run=False).join(marks, MESSAGE_KEY, "left_anti")


def run_digest(
    tables: MailTables,
    deliver: Callable[[DataFrame], None],
    end: datetime | None = None,
    zone: str = fixed.DEFAULT_ZONE,
    page_size: int = 1000,
) -> DataFrame:
    """Deliver the digest of every mailbox, then complete it; returns the ledger rows.

    ``deliver`` gets the pages (mailbox, window, page, text). If it raises, nothing is completed
    and all rows stay pending. A crash between delivery and the ledger delivers twice.
    """
    end = F.lit(end or datetime.now(timezone.utc)).cast("timestamp")
    windows = stage(
        window_bounds(tables.cursors(), tables.digests(), end, zone), "digest-windows"
    )
    rows = stage(pending_rows(tables, windows), "digest-rows")
    deliver(digest_text(windows, digest_cards(rows, zone), zone, page_size))
    ledger = stage(ledger_rows(windows, rows), "digest-ledger")
    tables.complete_digest(mark_digested(rows), ledger)
    return ledger
