"""Digest windows, cards, documents and the ledger."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.text import empty_to_null, format_address, trim_space
from mailframe.functions.timing import days_before, to_local, utc_second
from mailframe.schemas import MESSAGE_KEY

WINDOW_KEY = ["mailbox", "window_start", "window_end"]


# --- windows ---------------------------------------------------------------


def last_digest(ledger: DataFrame) -> DataFrame:
    """Per mailbox the end of the last completed window."""
    return ledger.groupBy("mailbox").agg(F.max("window_end").alias("last_digest_at"))


def window_bounds(
    mailboxes: DataFrame, ledger: DataFrame, end: Column, zone: str = fixed.DEFAULT_ZONE
) -> DataFrame:
    """The window of a run at ``end``: from the last digest, or seven calendar days back."""
    end = utc_second(end)
    return (
        mailboxes.select("mailbox")
        .join(last_digest(ledger), "mailbox", "left")
        .select(
            "mailbox",
            F.coalesce(F.col("last_digest_at"), days_before(end, zone).cast("timestamp")).alias(
                "window_start"
            ),
            end.alias("window_end"),
        )
    )


def window_chain(runs: DataFrame, zone: str = fixed.DEFAULT_ZONE) -> DataFrame:
    """Contiguous windows from each mailbox's successful run times (mailbox, run_at).

    A failed or skipped run is simply not in ``runs``; its span belongs to the next window.
    """
    order = Window.partitionBy("mailbox").orderBy("run_at")
    run = utc_second("run_at")
    return (
        runs.select("mailbox", run.alias("run_at"))
        .withColumn("_previous", F.lag("run_at").over(order))
        .select(
            "mailbox",
            F.coalesce("_previous", days_before("run_at", zone)).alias("window_start"),
            F.col("run_at").alias("window_end"),
        )
    )


def digest_id(mailbox: str = "mailbox", end: str = "window_end") -> Column:
    """The same id every time one window is completed, so a repeated run changes nothing."""
    return F.sha2(F.concat_ws("|", mailbox, F.unix_seconds(F.col(end).cast("timestamp"))), 256)


# --- assignment ------------------------------------------------------------


def pending(
    messages: DataFrame, start: Column, end: Column, marks: DataFrame | None = None
) -> DataFrame:
    """Undigested rows of the half-open window; the bounds reach the Parquet scan."""
    rows = messages.where(
        (F.col("received_at") >= utc_second(start)) & (F.col("received_at") < utc_second(end))
    )
    return rows if marks is None else rows.join(marks, MESSAGE_KEY, "left_anti")


def _bucket(c: Column | str) -> Column:
    return F.unix_date(F.col(c).cast("date") if isinstance(c, str) else c.cast("date"))


def assign_windows(
    df: DataFrame, windows: DataFrame, how: str = "inner", as_of_run: bool = True
) -> DataFrame:
    """Join every message to the window ``start <= received_at < end`` of its mailbox.

    Over a history of windows a message counts for one only if it had been processed by that run
    (``as_of_run``), in its own second at the latest. A run that takes place now has only what is
    there, and tests nothing but the marks. Windows are
    listed once per day they touch, messages join on (mailbox, day) and the range is checked
    behind that: an equi join whose keys also split a hot mailbox by day. Windows of a mailbox do
    not overlap, so a message finds one at most, and ``left`` keeps every message once.
    """
    days = F.sequence(_bucket("window_start"), _bucket("window_end"))
    listed = windows.select(*WINDOW_KEY, F.explode(days).alias("_day")).withColumnRenamed(
        "mailbox", "_mailbox"
    )
    left = df.withColumn("_day", _bucket("received_at")).alias("m")
    right = listed.alias("w")
    on = (
        (F.col("m.mailbox") == F.col("w._mailbox"))
        & (F.col("m._day") == F.col("w._day"))
        & (F.col("m.received_at") >= F.col("w.window_start"))
        & (F.col("m.received_at") < F.col("w.window_end"))
    )
    if as_of_run:
        on = on & (F.col("m.processed_at") <= F.col("w.window_end"))
    return left.join(right, on, how).select(
        *(F.col(f"m.{c}") for c in df.columns), "w.window_start", "w.window_end"
    )


def audit_windows(df: DataFrame, windows: DataFrame) -> DataFrame:
    """All messages with their window, and ``stranded`` where no digest will ever hold them.

    Windows are over header time: mail that arrives with a date before the last completed window
    is too late, and so is mail older than the first window.
    """
    last = windows.groupBy("mailbox").agg(F.max("window_end").alias("_last"))
    late = F.col("window_end").isNull() & (F.col("received_at") < F.col("_last"))
    return (
        assign_windows(df, windows, "left")
        .join(last, "mailbox", "left")
        .withColumn("stranded", F.coalesce(late, F.lit(False)))
        .drop("_last")
    )


def digest_sizes(windows: DataFrame, assigned: DataFrame) -> DataFrame:
    """``email_count`` per window, 0 for an empty one."""
    counts = assigned.groupBy(*WINDOW_KEY).agg(F.count("*").alias("email_count"))
    return windows.join(counts, WINDOW_KEY, "left").withColumn(
        "email_count", F.coalesce("email_count", F.lit(0))
    )


# --- presentation ----------------------------------------------------------


def digest_cards(df: DataFrame, zone: str = fixed.DEFAULT_ZONE) -> DataFrame:
    """Add the display columns of a digest row; all other columns are kept."""

    def shown(c: Column, default: str) -> Column:
        return F.coalesce(empty_to_null(c), F.lit(default))

    tone = shown(F.col("tone"), fixed.TONES[0])
    return df.withColumns(
        {
            "card_date": F.date_format(to_local("received_at", zone), fixed.CARD_TIME),
            "card_from": shown(format_address("from_name", "from_addr"), fixed.UNKNOWN_SENDER),
            "card_subject": shown(trim_space("subject"), fixed.NO_SUBJECT),
            "card_summary": shown(trim_space("summary"), fixed.FAILED_SUMMARY),
            "card_action": shown(F.col("action_req"), fixed.ACTIONS[0]),
            "card_deadline": F.coalesce("deadline", F.lit("")),
            "card_tone": tone,
            "card_original": F.col("raw_path"),
            "is_heated": tone == fixed.TONES[1],
            "is_error": F.coalesce(F.col("llm_status") == "error", F.lit(False)),
            "is_out_of_scope": ~F.col("in_scope"),
        }
    )


def card_block() -> Column:
    """One card as the lines it has in the text digest."""
    status = F.concat(
        F.lit("Action: "),
        F.col("card_action"),
        F.when(F.col("card_deadline") != "", F.concat(F.lit(" | Deadline: "), "card_deadline"))
        .otherwise(""),
        F.lit(" | Tone: "),
        F.col("card_tone"),
        F.when(F.col("is_error"), " | Summary error").otherwise(""),
        F.when(F.col("is_out_of_scope"), " | Out of scope").otherwise(""),
    )
    return F.concat_ws(
        "\n",
        F.lit(""),
        F.lit("---"),
        F.concat_ws(" | ", "card_date", "card_from"),
        F.col("card_subject"),
        F.col("card_summary"),
        status,
        F.concat(F.lit("Original: "), F.col("card_original")),
        F.lit(""),
    )


def _with_position(cards: DataFrame, group: list[str]) -> DataFrame:
    """Add the row's 0-based rank in ``group`` by (received_at, uid_validity, uid).

    Exact, and with no window over an unbounded group: rows are counted per cell (second, epoch,
    uid / 65536), cells are summed up within a minute, minutes within the group. A cell holds at
    most 65,536 rows because uids are unique in an epoch, a minute at most 60 x 65,536 cells per
    epoch, a group one entry per minute of its span. Only the last step touches the rows, and its
    shuffle is by cell, which no hot mailbox can bend.
    """
    cell = ["_minute", "received_at", "uid_validity", "_high"]
    celled = cards.withColumn(
        "_minute", F.expr("unix_seconds(cast(received_at as timestamp)) div 60")
    ).withColumn("_high", F.expr("uid div 65536"))
    cells = celled.groupBy(*group, *cell).agg(F.count("*").alias("_n"))
    before = (Window.unboundedPreceding, -1)

    minutes = (
        cells.groupBy(*group, "_minute")
        .agg(F.sum("_n").alias("_m"))
        .withColumn(
            "_minute_start",
            F.sum("_m").over(Window.partitionBy(*group).orderBy("_minute").rowsBetween(*before)),
        )
        .select(*group, "_minute", F.coalesce("_minute_start", F.lit(0)).alias("_minute_start"))
    )
    in_minute = Window.partitionBy(*group, "_minute").orderBy(*cell[1:]).rowsBetween(*before)
    starts = (
        cells.withColumn("_cell_start", F.coalesce(F.sum("_n").over(in_minute), F.lit(0)))
        .join(minutes, [*group, "_minute"])
        .select(*group, *cell, (F.col("_minute_start") + F.col("_cell_start")).alias("_start"))
    )
    in_cell = Window.partitionBy(*group, *cell).orderBy("uid")
    return (
        celled.join(starts, [*group, *cell])
        .withColumn("_position", F.col("_start") + F.row_number().over(in_cell) - 1)
        .drop("_minute", "_high", "_start")
    )


def zone_name(instant: Column | str, local: Column, zone: str) -> Column:
    """The zone's short name at an instant, by the offset between its clock and UTC.

    A zone without names, such as a plain offset, is shown as ``zone`` itself.
    """
    try:
        rules = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        return F.lit(zone)
    names = {}
    for year in range(1970, 2038):
        for month in range(1, 13):
            at = datetime(year, month, 1, tzinfo=timezone.utc).astimezone(rules)
            names[int(at.utcoffset().total_seconds())] = at.tzname()
    moment = F.col(instant) if isinstance(instant, str) else instant
    offset = F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))
    shown = F.lit(zone)
    for seconds, name in sorted(names.items()):
        shown = F.when(offset == seconds, F.lit(name)).otherwise(shown)
    return shown


def digest_text(
    windows: DataFrame,
    cards: DataFrame,
    zone: str = fixed.DEFAULT_ZONE,
    page_size: int = 1000,
) -> DataFrame:
    """The text digest of every window as pages (mailbox, window, page, text).

    Joining the pages of a window gives the document; up to ``page_size`` cards it is page 0
    alone. Pages exist so that the digest of a mailbox with a third of all mail is not one cell of
    one row.
    """

    def bound(c: str) -> Column:
        local = to_local(c, zone)
        return F.concat(F.date_format(local, fixed.CARD_TIME), F.lit(" "), zone_name(c, local, zone))

    blocks = _with_position(
        cards.select(*WINDOW_KEY, "received_at", "uid_validity", "uid", card_block().alias("_block")),
        WINDOW_KEY,
    ).withColumn("page", F.expr(f"_position div {int(page_size)}"))
    listed = F.array_sort(F.collect_list(F.struct("_position", "_block")))
    pages = blocks.groupBy(*WINDOW_KEY, "page").agg(
        F.array_join(F.transform(listed, lambda b: b["_block"]), "").alias("_body")
    )
    head = F.concat(
        F.lit(fixed.DIGEST_TITLE + "\n"), bound("window_start"), F.lit(" to "),
        bound("window_end"), F.lit("\n"),
    )
    filled = pages.select(
        *WINDOW_KEY,
        "page",
        F.concat(F.when(F.col("page") == 0, head).otherwise(""), "_body").alias("text"),
    )
    # Pages carry their window, so only empty windows are looked up. Joining the pages to the
    # windows would send all pages of one window to one task.
    empty = windows.join(cards.select(*WINDOW_KEY).distinct(), WINDOW_KEY, "left_anti").select(
        *WINDOW_KEY,
        F.lit(0).cast("bigint").alias("page"),
        F.concat(head, F.lit("\n" + fixed.DIGEST_EMPTY + "\n")).alias("text"),
    )
    return filled.unionByName(empty)


# --- completion ------------------------------------------------------------


def mark_digested(assigned: DataFrame, at: Column | str = "window_end") -> DataFrame:
    """The marks a completed digest leaves on its messages, as rows to append."""
    at = F.col(at) if isinstance(at, str) else at
    return assigned.select(
        *MESSAGE_KEY,
        digest_id().alias("digest_id"),
        utc_second(at).alias("digested_at"),
        F.date_format("received_at", "yyyy-MM").alias("received_month"),
    )


def ledger_rows(windows: DataFrame, assigned: DataFrame) -> DataFrame:
    """One ledger row per window, also for an empty digest."""
    return digest_sizes(windows, assigned).select(
        digest_id().alias("digest_id"),
        "mailbox",
        F.col("window_end").alias("sent_at"),
        "window_start",
        "window_end",
        "email_count",
    )


def completed_marks(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """``digested_at`` per message: first mark wins, marks of an unfinished digest do not count."""
    return (
        items.join(ledger.select("digest_id").distinct(), "digest_id", "left_semi")
        .groupBy(*MESSAGE_KEY)
        .agg(F.min("digested_at").alias("digested_at"))
    )
