"""The registered queries: every operator over whole tables, each with named output columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailframe.functions import replies, text, timing
from mailframe.operators import archive, dedupe, digest, incremental, model, report, scope
from mailframe.plans.corpus_run import summarize_corpus
from mailframe.plans.poll import PollSettings, poll
from mailframe.plans.weekly import run_digest
from mailframe.schemas import RAW_MAIL
from mailframe.session import stage, work_dir
from mailframe.sources import adapters
from mailframe.sources.corpus import parse_mail, scan_corpus
from mailframe.sources.corpus_files import write_files
from mailframe.sources.tables import MailTables, write_records
from mailframe.streaming import digests
from mailframe.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

ZONE = "America/Toronto"
CUT = "2024-01-20"
WEEK = ("2024-01-08 13:00:00", "2024-01-15 13:00:00")
# A digest that was never delivered: its span belongs to the window after it.
FAILED_RUN = ("click", "2024-01-22 13:00:00")


def _ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


# --- text --------------------------------------------------------------------


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = adapters.table(spark, sf, "pages").select("page_id", "html")
    body = text.with_steps(pages, "body_text", "html", *text.STRIP_HTML, *text.NORMALIZE)
    return body.select("page_id", "body_text")


def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = adapters.table(spark, sf, "pages").select("page_id", "html")
    return text.with_steps(pages, "stripped", "html", *text.STRIP_HTML).select(
        "page_id", "stripped"
    )


def clean_reply(spark: SparkSession, sf: str) -> DataFrame:
    threads = adapters.reply_threads(spark, sf)
    cleaned = text.with_clean_body(threads, "body", None, 500)
    return cleaned.select("conv_id", "turn", "body_text", "truncated")


def message_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = adapters.table(spark, sf, "pages")
    name = F.regexp_extract("url", r"://([^/]+)", 1)
    return pages.select(
        "page_id",
        text.trim_id(F.concat(F.lit(" <"), "url", F.lit(">\t"))).alias("message_id"),
        text.safe_name("url").alias("file_name"),
        text.format_address(F.when(F.col("page_id") % 3 > 0, name), "url").alias("sender"),
        text.empty_to_null(F.regexp_extract("url", r"\?(.*)", 1)).alias("query_part"),
    )


def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.document_batch(spark, sf).select(
        "uid",
        text.format_address("source", F.concat("lang", F.lit("@example.test"))).alias("from_display"),
        F.concat(F.lit("note "), "n_chars").alias("subject"),
        F.col("text").alias("body_text"),
    )
    return model.build_prompt(docs, "en", strict=True).select("uid", "system_prompt", "user_prompt")


# --- scope and outcome -------------------------------------------------------


def _allowlist(events: DataFrame) -> DataFrame:
    """Senders of any high-value signup, as entries with stray blanks and letter case."""
    high = events.where((F.col("mailbox") == "signup") & (F.col("value") > 60))
    return high.select(F.concat(F.lit("  "), F.upper("from_addr"), F.lit("\t")).alias("entry"))


def scope_flag(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf)
    flagged = scope.flag_scope(events, _allowlist(events))
    return flagged.select("mailbox", "uid", "from_addr", "in_scope")


def received_at(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf)
    sent = F.when(F.col("value") >= 5, F.col("ts"))
    processed = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(6))
    return events.select("uid", timing.received_at(sent, processed).alias("received_at"))


def outcome_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.document_batch(spark, sf)
    labels = adapters.table(spark, sf, "labels").withColumnRenamed("doc_id", "uid")
    ok = F.coalesce(F.col("quality"), F.lit(0)) == 1
    summary = F.struct(
        F.when(ok, F.col("text")).otherwise("could not summarize").alias("text"),
        F.when(ok, "fyi").alias("action"),
        F.when(ok & (F.col("toxic") == 0), "2024-03-01").when(ok, "").alias("deadline"),
        F.when(ok & (F.col("toxic") == 1), "heated").when(ok, "neutral").alias("tone"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, "validation failed after retry").alias("err"),
    )
    rows = docs.join(labels, "uid", "left").select(
        "uid",
        F.when(F.col("n_chars") < 200, F.concat(F.lit("short by "), F.lit(200) - F.col("n_chars")))
        .alias("parse_error"),
        (F.col("lang") != "de").alias("in_scope"),
        summary.alias("model"),
    )
    return scope.route_outcome(rows).drop("parse_error")


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf).withColumn(
        "message_id", F.concat_ws("-", "user_id", F.floor("value"))
    )
    fresh = dedupe.first_per_key(events, ["mailbox", "message_id"], ["uid"])
    flagged = scope.flag_scope(fresh, [f"user{n}@example.test" for n in range(100)])
    status = F.when(F.col("value") < 3, "error").otherwise("ok")
    return scope.batch_counts(events, flagged.withColumn("llm_status", status))


# --- incremental -------------------------------------------------------------


def _cursors(events: DataFrame) -> DataFrame:
    """Cursors as of the cut; one mailbox has since changed its epoch, one is new."""
    before = events.where((F.col("ts") < _ntz(CUT)) & (F.col("mailbox") != "error"))
    return before.groupBy("mailbox", "uid_validity").agg(F.max("uid").alias("last_uid"))


def _state(events: DataFrame) -> DataFrame:
    epoch = F.when(F.col("mailbox") == "signup", 2).otherwise(F.col("uid_validity"))
    return events.groupBy("mailbox", epoch.cast("bigint").alias("uid_validity")).agg(
        (F.max("uid") + 1).alias("uid_next")
    )


def new_since_cursor(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf)
    cursors = stage(_cursors(events), "cursors")
    new = incremental.new_since(events, cursors, _state(events))
    return new.select("mailbox", "uid_validity", "uid")


def log_since_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a raw log in folders; one mailbox has been idle from its first message on."""
    events = adapters.event_log(spark, sf)
    tables = MailTables(spark, work_dir(spark, "store"), box_buckets=16, uid_block=8192)
    tables.append_raw(events.withColumn("raw", F.col("props").cast("binary")))
    idle = events.where("mailbox = 'error'").groupBy("mailbox", "uid_validity").agg(F.min("uid").alias("last_uid"))
    cursors = stage(_cursors(events).unionByName(idle), "cursors")
    new = tables.raw_since(cursors, _state(events))
    return new.select("mailbox", "uid_validity", "uid", F.col("raw").cast("string").alias("props"))


def baseline_reset(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf)
    return incremental.baseline(_state(events), _cursors(events))


def advance_cursors(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf)
    cursors, state = _cursors(events), _state(events)
    resets = incremental.baseline(state, cursors).where("initialized")
    new = incremental.new_since(events, cursors, state)
    return incremental.advance_cursors(cursors, resets, incremental.batch_moves(new))


def _stored_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents are the stored ones; the batch is everything, under shifted uids."""
    docs = adapters.document_batch(spark, sf)
    labels = adapters.table(spark, sf, "labels").select(F.col("doc_id").alias("uid"))
    keys = docs.select("mailbox", "uid_validity", "uid", "message_id", "n_chars")
    # Even lengths come under a uid of their own, so that only the id can tell they are known.
    moved = F.when(F.col("n_chars") % 2 == 0, F.col("uid") + 1_000_000_000).otherwise(F.col("uid"))
    return keys.join(labels, "uid", "left_semi"), keys.withColumn("uid", moved)


def known_filter(spark: SparkSession, sf: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, sf)
    return incremental.unknown_only(batch, stored).select("uid", "message_id")


def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, sf)
    return incremental.insert_absent(batch, stored, unique_uids=True).select("uid", "message_id")


def batch_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.document_batch(spark, sf).select("mailbox", "uid", "message_id")
    kept = dedupe.dedupe_two_keys(docs, ["uid"], ["uid"], ["mailbox", "message_id"], unique_a=True)
    return kept.select("uid", "message_id")


def batch_dedupe_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Neither key is unique: the batch holds repeated uids and repeated ids."""
    rows = adapters.event_log(spark, sf).select(
        F.col("uid").alias("arrival"),
        F.concat_ws("-", "mailbox", "user_id").alias("sender_key"),
        F.when(F.col("value") >= 1, F.concat_ws("-", F.to_date("ts"), F.floor("value"))).alias(
            "message_id"
        ),
    )
    return dedupe.dedupe_two_keys(rows, ["arrival"], ["sender_key"], ["message_id"])


def dedupe_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Redelivered mail under ever new ids: each row shares one key with the row before it.

    A small value breaks the chain, so that chains of many lengths, the longest in the hundreds or
    thousands, decide their rows in turns.
    """
    n = F.col("uid")
    linked = F.col("value") >= 0.1
    rows = adapters.event_log(spark, sf).select(
        n.alias("arrival"),
        F.when(linked | (n % 2 == 1), F.expr("concat('u', (uid + 1) div 2)")).alias("uid_key"),
        F.when(linked | (n % 2 == 0), F.expr("concat('m', uid div 2)")).alias("id_key"),
    )
    return dedupe.dedupe_two_keys(rows, ["arrival"], ["uid_key"], ["id_key"])


def known_index(spark: SparkSession, sf: str) -> DataFrame:
    """A batch against a hundred times more stored mail, of which the index opens few files."""
    tables = MailTables(spark, work_dir(spark, "store"))
    message_id = F.concat_ws("-", "user_id", F.floor("value"))
    logged = adapters.event_log(spark, sf).select("uid", message_id.alias("message_id"))
    stored = _as_stored(adapters.event_messages(spark, sf).join(logged, "uid"))
    for delivery in (0, 1):
        tables.append_messages(stored.where(F.col("uid") % 2 == delivery))
    batch = adapters.table(spark, sf, "supplier").select(
        F.lit("click").alias("mailbox"),
        F.lit(1).cast("bigint").alias("uid_validity"),
        (F.col("s_suppkey") * 7).alias("uid"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat_ws("-", "s_nationkey", F.col("s_suppkey") % 100)).alias("message_id"),
    )
    return incremental.unknown_only(batch, tables.messages_like(batch)).select("uid", "message_id")


# --- replies -----------------------------------------------------------------


def _with_replies(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.document_batch(spark, sf)
    error = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("call failed after "), "n_chars"))
    return docs.select(
        "uid",
        adapters.model_reply(F.col("uid") % 12, F.col("text")).alias("raw_1"),
        adapters.model_reply(F.floor(F.col("uid") / 12) % 12, F.col("text")).alias("raw_2"),
        F.when(F.col("n_chars") % 7 == 0, "no connection").alias("call_error_1"),
        error.alias("call_error_2"),
        F.col("n_chars").alias("latency_ms_1"),
        (F.col("n_chars") * 2).alias("latency_ms_2"),
    )


def validate_reply(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.document_batch(spark, sf)
    raw = adapters.model_reply(F.col("uid") % 12, F.col("text"))
    checked = replies.with_validation(docs.select("uid", raw.alias("raw")))
    return checked.select("uid", "checked.*")


def pick_attempt(spark: SparkSession, sf: str) -> DataFrame:
    picked = model.pick_attempt(_with_replies(spark, sf))
    return picked.select("uid", "model.*", "latency_ms", "retried")


def model_attempts(spark: SparkSession, sf: str, factory: model.ClientFactory) -> DataFrame:
    docs = adapters.document_batch(spark, sf).select(
        "uid",
        F.col("source").alias("from_display"),
        F.lit("note").alias("subject"),
        F.col("text").alias("body_text"),
    )
    answered = model.pick_attempt(model.summarize(docs, factory, ["uid"]))
    return answered.select("uid", "model.*", "retried")


# --- lint and report ---------------------------------------------------------


def _linted(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.document_batch(spark, sf)
    failed = F.col("n_chars") % 13 == 0
    rows = docs.select(
        "uid",
        "lang",
        F.struct(
            F.col("text").alias("text"),
            F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(failed, F.concat(F.lit("failed at "), "n_chars")).alias("err"),
        ).alias("model"),
        (F.col("n_chars") > 4000).alias("truncated"),
        F.when(F.col("n_chars") % 17 == 0, "unreadable").alias("parse_error"),
        F.col("n_chars").alias("latency_ms"),
    )
    linted = replies.with_lint(rows, "model.text", "model.status", "model.err", "truncated")
    return linted.withColumn("status", F.col("model.status"))


def lint_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _linted(spark, sf).select("uid", F.concat_ws("; ", "checks").alias("checks"))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.run_report(_linted(spark, sf), ["lang"])


def records_json(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "records")
    write_records(_linted(spark, sf).select("uid", "lang", "latency_ms", "checks", "model"), path)
    back = spark.read.schema(
        "uid long, lang string, latency_ms long, checks array<string>, model struct<text:string>"
    ).json(path)
    return back.select(
        "uid", "lang", "latency_ms", F.size("checks").cast("bigint").alias("n_checks"),
        F.md5("model.text").alias("text_md5"),
    )


# --- archive -----------------------------------------------------------------


def _page_mail(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as originals; the host is the id, so many different originals share a name."""
    hours = F.make_dt_interval(F.lit(0), F.col("page_id").cast("int") % 2000)
    return adapters.table(spark, sf, "pages").select(
        F.lit("web").alias("mailbox"),
        F.lit(1).cast("bigint").alias("uid_validity"),
        F.col("page_id").alias("uid"),
        F.when(F.col("page_id") % 10 > 0, F.regexp_extract("url", r"://([^/]+)", 1)).alias("message_id"),
        (_ntz("2024-01-01 00:00:00") + hours).alias("received_local"),
        F.col("html").cast("binary").alias("raw"),
        F.sha2("html", 256).alias("sha"),
        F.col("url").startswith("https:").alias("is_second"),
    )


def archive_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = archive.archive_paths(_page_mail(spark, sf).drop("raw"))
    return paths.select("uid", "base_path", "raw_path")


def archive_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries, the second one holding everything again: each original is stored once."""
    tables = MailTables(spark, work_dir(spark, "store"))
    mail = _page_mail(spark, sf)
    for delivery in (mail.where("not is_second"), mail):
        paths = stage(archive.archive_paths(delivery.drop("raw"), tables.archive()), "paths")
        tables.append_archive(archive.new_archive_rows(paths, delivery, tables.archive()))
    return tables.archive().select(
        "raw_path", "sha", F.octet_length("raw").cast("bigint").alias("n_bytes"), "year", "month"
    )


# --- digest ------------------------------------------------------------------


def _runs(messages: DataFrame) -> DataFrame:
    """The weekly runs that the data spans, without one that failed, and an empty week after it."""
    run = timing.next_week_start("received_at", ZONE)
    runs = messages.select("mailbox", run.alias("run_at")).distinct()
    after = runs.select("mailbox", timing.next_week_start("run_at", ZONE).alias("run_at"))
    failed = (F.col("mailbox") == FAILED_RUN[0]) & (F.col("run_at") == _ntz(FAILED_RUN[1]))
    return runs.unionByName(after).distinct().where(~failed)


def _windows(messages: DataFrame) -> DataFrame:
    return digest.window_chain(_runs(messages), ZONE)


def week_start(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.event_log(spark, sf)
    return events.select("uid", timing.week_start("ts", ZONE).alias("week_start"))


def digest_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(adapters.event_messages(spark, sf))


def window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The next window of every mailbox; those with a digest continue it, others look back."""
    messages = adapters.event_messages(spark, sf)
    ledger = _windows(messages).where(F.col("mailbox") != "view")
    end = F.lit("2024-03-11 12:00:00.75").cast("timestamp")
    boxes = messages.select("mailbox").distinct()
    bounds = digest.window_bounds(boxes, ledger, end, ZONE)
    return bounds.select(
        "mailbox",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
    )


def last_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest.last_digest(_windows(adapters.event_messages(spark, sf)))


def pending_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Undigested rows of one week; marks of an unfinished digest do not count."""
    messages = adapters.event_messages(spark, sf, *WEEK)
    name = F.when(F.col("action_req") == "reply", "done").when(F.col("llm_status") == "error", "open")
    at = timing.utc_second(F.col("processed_at"))
    items = adapters.event_messages(spark, sf).select(
        "mailbox", "uid_validity", "uid", name.alias("digest_id"), at.alias("digested_at")
    ).where("digest_id is not null")
    ledger = items.where("digest_id = 'done'").select("digest_id").distinct()
    marks = digest.completed_marks(items, ledger)
    return digest.pending(messages, _ntz(WEEK[0]), _ntz(WEEK[1]), marks).select(
        "mailbox", "uid", "received_at", "subject"
    )


def digest_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A card for every message, with dates moved to both sides of a clock change in March."""
    moved = F.col("received_at") + F.make_dt_interval(F.lit(50))
    cards = digest.digest_cards(adapters.event_messages(spark, sf).withColumn("received_at", moved), ZONE)
    shown = [c for c in cards.columns if c.startswith(("card_", "is_"))]
    return cards.select("mailbox", "uid", *shown)


def digest_assignment(spark: SparkSession, sf: str) -> DataFrame:
    messages = adapters.event_messages(spark, sf)
    audited = digest.audit_windows(messages, stage(_windows(messages), "windows"))
    return audited.select("mailbox", "uid", "window_start", "window_end", "stranded")


def digest_sizes(spark: SparkSession, sf: str) -> DataFrame:
    messages = adapters.event_messages(spark, sf)
    windows = stage(_windows(messages), "windows")
    return digest.digest_sizes(windows, digest.assign_windows(messages, windows))


def digest_text(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and their rows are written once: the document reads them several times."""
    messages = adapters.event_messages(spark, sf)
    windows = stage(_windows(messages), "windows")
    rows = stage(digest.assign_windows(messages, windows), "rows")
    return digest.digest_text(windows, digest.digest_cards(rows, ZONE), ZONE, page_size=100)


def mark_digested(spark: SparkSession, sf: str) -> DataFrame:
    messages = adapters.event_messages(spark, sf)
    marks = digest.mark_digested(digest.assign_windows(messages, _windows(messages)))
    return marks.select("mailbox", "uid", "digest_id", "digested_at")


def _as_stored(rows: DataFrame) -> DataFrame:
    """Event messages in the shape of the message table; without an id unless they have one."""
    instants = {c: F.col(c).cast("timestamp") for c in ("received_at", "processed_at")}
    absent = {c: F.lit(None).cast("string") for c in ("message_id", "llm_error") if c not in rows.columns}
    return rows.withColumns(instants | absent)


def _stored_events(spark: SparkSession, sf: str) -> MailTables:
    """A store that holds the event log, with a cursor per mailbox."""
    tables = MailTables(spark, work_dir(spark, "store"))
    tables.append_messages(_as_stored(adapters.event_messages(spark, sf)))
    tables.write_cursors(incremental.batch_moves(tables.messages()), 0)
    return tables


def digest_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs against a store, the first of them once more after a failed delivery."""
    tables = _stored_events(spark, sf)

    def fail(pages: DataFrame) -> None:
        raise RuntimeError("not delivered")

    try:
        run_digest(tables, fail, datetime(2024, 1, 15, 13), ZONE)
    except RuntimeError:
        pass
    for end in (datetime(2024, 1, 16, 13), datetime(2024, 1, 22, 13)):
        run_digest(tables, lambda pages: pages.write.parquet(work_dir(spark, "sent")), end, ZONE)
    return tables.digests().select(
        "mailbox",
        *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("sent_at", "window_start", "window_end")),
        "email_count",
    )


# --- sources, polls, streams -------------------------------------------------


def mail_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_mail(adapters.raw_documents(spark, sf))
    return parsed.select(
        "uid", text.empty_to_null("message_id").alias("message_id"), "from_name", "from_addr",
        "subject", "body_text", "truncated", "has_attachment", "sent_local",
        F.col("sent_at").cast("timestamp_ntz").alias("sent_at"),
    )


def mail_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments, HTML only, encoded words, unreadable dates, no mail, alternatives."""
    parsed = parse_mail(adapters.mail_shapes(spark, sf))
    return parsed.select(
        "uid", "from_name", "from_addr", "subject", "body_text",
        F.coalesce("has_attachment", F.lit(False)).alias("has_attachment"),
        F.col("parse_error").isNotNull().alias("unread"), "sent_local",
        F.col("sent_at").cast("timestamp_ntz").alias("sent_at"),
    )


def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as .txt files, found and read by the corpus scan."""
    path = work_dir(spark, "corpus")
    docs = adapters.table(spark, sf, "documents").select("lang", "text")
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    files = scan_corpus(spark, path).select(
        F.regexp_extract("path", r"lang=([^/]*)/", 1).alias("lang"),
        F.col("content").cast("string").alias("content"),
    )
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.groupBy("lang").agg(
        F.sum(lines).alias("n_lines"), F.sum(F.length("content")).alias("n_chars")
    )


def corpus_run(spark: SparkSession, sf: str, factory: model.ClientFactory) -> DataFrame:
    """A folder of mail and text files, summarised and written in order, with the totals of the run."""
    folder, out = work_dir(spark, "corpus"), work_dir(spark, "records")
    write_files(adapters.corpus_files(spark, sf), folder)
    totals = report.write_run(summarize_corpus(scan_corpus(spark, folder), factory), out)
    shape = "path string, from_display string, subject string, parse_error string, status string, checks array<string>"
    back = spark.read.schema(shape).json(out).select(
        "*", "_metadata.file_name", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")
    )
    # The place of a record in the files as written, one after another.
    files = back.groupBy("file_name").agg(F.count("*").alias("n"))
    before = files.select("file_name", (F.sum("n").over(Window.orderBy("file_name")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("file_name").orderBy("at"))
    shown = ("total", "ok", "error", "validation_warn")
    return back.join(before, "file_name").select(
        place.alias("place"),
        F.substring_index("path", "/", -2).alias("name"),
        "from_display",
        "subject",
        F.col("parse_error").isNotNull().alias("unread"),
        "status",
        F.size("checks").cast("bigint").alias("n_checks"),
        *(F.lit(totals[c]).cast("bigint").alias(c) for c in shown),
        F.lit(totals["has_warnings"]).alias("has_warnings"),
    )


def _messages_out(tables: MailTables) -> DataFrame:
    return tables.messages().select(
        "mailbox", "uid", "message_id", "from_name", "from_addr", "subject", "raw_path", "summary",
        "action_req", "deadline", "tone", "in_scope", "llm_status", "llm_error",
        F.col("received_at").cast("timestamp_ntz").alias("received_at"),
    )


def _settings(factory: model.ClientFactory) -> PollSettings:
    listed = [f"SRC{n}@example.test" for n in range(15)]
    return PollSettings(factory, allowlist=listed, zone=ZONE, body_limit=0)


def poll_run(spark: SparkSession, sf: str, factory: model.ClientFactory) -> DataFrame:
    """Documents as raw mail through a whole poll: all mailboxes have a cursor below the mail."""
    tables = MailTables(spark, work_dir(spark, "store"))
    raw = adapters.raw_documents(spark, sf)
    state = raw.groupBy("mailbox", "uid_validity").agg((F.max("uid") + 1).alias("uid_next"))
    start = raw.select("mailbox", "uid_validity", F.lit(-1).cast("bigint").alias("last_uid"))
    tables.write_cursors(start.distinct(), 0)
    poll(tables, raw, state, _settings(factory), datetime(2024, 2, 1))
    return _messages_out(tables)


def stream_ingest(spark: SparkSession, sf: str, factory: model.ClientFactory) -> DataFrame:
    """The same mail as a stream that stops and resumes, the second part repeating the first."""
    tables = MailTables(spark, work_dir(spark, "store"))
    incoming, checkpoint = work_dir(spark, "incoming"), work_dir(spark, "checkpoint")
    raw = adapters.raw_documents(spark, sf)
    # The first delivery ends in the middle of the uids.
    middle = raw.agg(F.expr("max(uid) div 2")).scalar()
    for part in (raw.where(F.col("uid") <= middle), raw):
        part.write.mode("append").parquet(incoming)
        source = spark.readStream.schema(RAW_MAIL).parquet(incoming)
        ingest_stream(source, tables, checkpoint, _settings(factory)).awaitTermination()
    return _messages_out(tables)


def stream_backlog(spark: SparkSession, sf: str, factory: model.ClientFactory) -> DataFrame:
    """A first start: each mailbox has a baseline, and the stream skips the mail below it."""
    tables = MailTables(spark, work_dir(spark, "store"))
    incoming, checkpoint = work_dir(spark, "incoming"), work_dir(spark, "checkpoint")
    raw = adapters.raw_documents(spark, sf)
    raw.write.parquet(incoming)
    half = F.expr("max(uid) div 2").alias("last_uid")
    baselines = stage(raw.groupBy("mailbox", "uid_validity").agg(half), "baselines")
    source = spark.readStream.schema(RAW_MAIL).parquet(incoming)
    ingest_stream(source, tables, checkpoint, _settings(factory), baselines).awaitTermination()
    return _messages_out(tables)


def digest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Windows closed by the clock of the stream; mail is processed up to nine days after its date.

    Three deliveries, each read by a run of the query of its own, overlap in processing time.
    """
    incoming, checkpoint, out = (work_dir(spark, name) for name in ("incoming", "checkpoint", "digests"))
    messages = adapters.event_messages(spark, sf).select("mailbox", "uid_validity", "uid", "received_at", "processed_at")
    last = messages.agg(F.max("uid")).scalar()
    for delivery in range(3):
        part = messages.where(F.floor(F.col("uid") * 3 / (last + 1)) == delivery)
        part.write.mode("append").parquet(incoming)
        source = spark.readStream.schema(messages.schema).parquet(incoming)
        stream = digests.digest_stream(source, "10 days", ZONE)
        digests.write_digests(stream, out, checkpoint, partitions=16).awaitTermination()
    totals = digests.window_totals(spark.read.parquet(out))
    bounds = (F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end"))
    return totals.select("mailbox", *bounds, "email_count", "late_count")


_QUERIES = (
    html_to_text, strip_html, clean_reply, message_names, build_prompt, scope_flag, received_at,
    outcome_rows, outcome_counts, new_since_cursor, baseline_reset, advance_cursors, known_filter,
    log_since_cursor, known_index, insert_absent, batch_dedupe, batch_dedupe_two_keys,
    dedupe_chain, validate_reply,
    pick_attempt, lint_summary, run_report, records_json, archive_paths, archive_sink, week_start,
    digest_windows, window_bounds, last_digest, pending_digest, digest_cards, digest_assignment,
    digest_sizes, digest_text, mark_digested, digest_ledger, mail_parse, mail_shapes, corpus_scan,
    digest_stream,
)
_WITH_MODEL = (model_attempts, poll_run, corpus_run, stream_ingest, stream_backlog)


def queries(factory: model.ClientFactory) -> dict[str, Query]:
    """The registered queries by name; those that ask a model get clients of ``factory``."""
    asking = {query.__name__: partial(query, factory=factory) for query in _WITH_MODEL}
    return {query.__name__: query for query in _QUERIES} | asking
