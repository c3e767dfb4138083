"""Generic tables in message shape, so that the operators can run on any data at hand.

``events`` is a mailbox log (event type = mailbox, event id = uid), ``documents`` are message
bodies with repeated texts, ``pages`` are HTML-only mail, ``conversations`` are reply threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailframe.functions.timing import utc_second


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailbox log: one epoch per mailbox, received time from the event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mailbox"),
        F.lit(1).cast("bigint").alias("uid_validity"),
        F.col("event_id").alias("uid"),
        F.concat(F.lit("User"), F.col("user_id"), F.lit("@Example.test")).alias("from_addr"),
        F.col("ts"),
        F.col("user_id"),
        F.col("value"),
        F.col("props"),
    )


def event_messages(
    spark: SparkSession, sf_dir: str, since: str | None = None, before: str | None = None
) -> DataFrame:
    """The log as stored messages. Some were processed days after their date and miss a digest.

    Bounds in whole seconds select the same rows before and after the fraction is cut; given here
    they are on the stored column and reach the Parquet scan.
    """
    lag = F.make_dt_interval((F.col("uid") % 10).cast("int"))
    log = event_log(spark, sf_dir)
    if since is not None:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if before is not None:
        log = log.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return log.select(
        "mailbox",
        "uid_validity",
        "uid",
        utc_second("ts").alias("received_at"),
        utc_second(F.col("ts") + lag).alias("processed_at"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("User "), "user_id")).alias("from_name"),
        F.when(F.col("user_id") % 7 > 0, F.col("from_addr")).alias("from_addr"),
        F.when(F.col("value") >= 5, F.concat(F.lit(" "), F.col("props"), F.lit("\t"))).alias(
            "subject"
        ),
        F.when(F.col("value") >= 2, F.concat(F.lit("value of "), F.col("props"))).alias("summary"),
        F.when(F.col("value") > 50, "reply").when(F.col("value") > 20, "fyi").alias("action_req"),
        F.when(F.col("value") > 50, "2024-02-15").alias("deadline"),
        F.when(F.col("value") > 80, "heated").when(F.col("value") > 10, "neutral").alias("tone"),
        (F.col("user_id") % 11 > 0).alias("in_scope"),
        F.when(F.col("value") < 2, "error").otherwise("ok").alias("llm_status"),
        F.concat(F.lit("archive/"), F.col("uid"), F.lit(".eml")).alias("raw_path"),
    )


def document_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one mailbox: the text's hash is the id, so exact copies share one."""
    return table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("mailbox"),
        F.lit(1).cast("bigint").alias("uid_validity"),
        F.col("doc_id").alias("uid"),
        F.when(F.instr("text", "\n") > 0, F.md5("text")).alias("message_id"),
        "text",
        "lang",
        "source",
        "n_chars",
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as RFC 5322 bytes, with the text as the plain body."""
    docs = document_batch(spark, sf_dir)
    head = F.concat(
        F.lit("From: "), F.col("source"), F.lit(" Desk <"), F.col("source"),
        F.lit("@example.test>\nSubject: note "), F.col("uid").cast("string"),
        F.lit("\nDate: Wed, 31 Jan 2024 23:30:00 -0500\nMIME-Version: 1.0\n"),
        F.coalesce(F.concat(F.lit("Message-Id: <"), F.col("message_id"), F.lit("@example.test>\n")),
                   F.lit("")),
        F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
    )
    return docs.select(
        F.col("lang").alias("mailbox"),
        "uid_validity",
        "uid",
        F.concat(head, F.col("text")).cast("binary").alias("raw"),
    )


def mail_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mail of six shapes, by uid: see ``kind`` for each.

    0 an attachment, 1 HTML only, 2 encoded words, 3 an unreadable date, 4 no mail at all, 5 plain
    and HTML alternatives.
    """
    kind = F.col("uid") % 6
    text = F.coalesce("text", F.lit(""))
    html = F.concat(
        F.lit("<style>p{color:red}</style><p>"), F.md5(text), F.lit(" &amp; "), "lang", F.lit("</p>")
    )
    title = F.concat(F.lit("note é "), F.col("uid").cast("string"))
    subject = F.when(
        kind == 2, F.concat(F.lit("=?utf-8?b?"), F.base64(title.cast("binary")), F.lit("?="))
    ).otherwise(title)
    date = F.when(kind == 3, "some day in spring").otherwise("Tue, 2 Jul 2024 09:15:00 +0200")
    typed = "Content-Type: {}; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
    # The boundary is one that no text holds.
    cut = F.concat(F.lit("part-"), F.sha2(text, 256))

    def parts(family: str, second: Column) -> Column:
        return F.concat(
            F.lit(f"Content-Type: multipart/{family}; boundary=\""), cut, F.lit("\"\n\n--"), cut,
            F.lit("\n" + typed.format("text/plain")), text, F.lit("\n\n--"), cut, F.lit("\n"), second,
            F.lit("\n--"), cut, F.lit("--\n"),
        )

    file = F.lit(
        "Content-Type: application/pdf\nContent-Disposition: attachment; filename=\"n.pdf\"\n"
        "Content-Transfer-Encoding: base64\n\nJVBERi0xLjQK\n"
    )
    page = F.concat(F.lit(typed.format("text/html")), html)
    body = (
        F.when(kind == 0, parts("mixed", file))
        .when(kind == 1, page)
        .when(kind == 5, parts("alternative", page))
        .otherwise(F.concat(F.lit(typed.format("text/plain")), text))
    )
    mail = F.concat(
        F.lit("From: "), "source", F.lit(" Desk <"), "source", F.lit("@example.test>\nSubject: "),
        subject, F.lit("\nDate: "), date, F.lit("\nMIME-Version: 1.0\n"), body,
    )
    raw = F.when(kind == 4, F.concat(F.lit("\n"), text)).otherwise(mail)
    return document_batch(spark, sf_dir).select("uid", raw.cast("binary").alias("raw"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): documents as files of six kinds, by uid, in a folder per language.

    Mail and text, names that begin with a dot or an underscore, extensions in capitals, empty
    files, and one kind that a corpus does not read.
    """
    number = F.col("uid").cast("string")
    names = [(".eml", ""), (".TXT", ""), (".txt", "_"), (".eml", "."), (".Eml", ""), (".md", "")]
    name = F.coalesce(*(F.when(F.col("uid") % 6 == i, F.concat(F.lit(a), number, F.lit(z))) for i, (z, a) in enumerate(names)))
    kind = F.col("uid") % 6
    content = F.when(kind.isin(0, 3), F.col("raw")).when(kind != 4, F.coalesce("text", F.lit("")).cast("binary"))
    texts = document_batch(spark, sf_dir).select("uid", "text")
    rows = raw_documents(spark, sf_dir).join(texts, "uid")
    return rows.select(F.concat(F.coalesce("mailbox", F.lit("none")), F.lit("/"), name).alias("name"), content.alias("content"))


def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as replies: new text, a header, the quoted turn before, a signature."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # The turn before by key; a window per conversation would put a long one into one task.
    before = turns.select(
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
        F.col("role").alias("_role"),
        F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> "))).alias("_quote"),
    )
    english = F.concat(F.lit("On day "), F.col("turn"), F.lit(", "), "_role", F.lit(" wrote:"))
    french = F.concat(F.lit("Le jour "), F.col("turn"), F.lit(", "), "_role", F.lit(" a écrit :"))
    quote = F.concat(
        F.when(F.col("turn") % 2 == 0, english).otherwise(french), F.lit("\n\n"), "_quote", F.lit("\n\n")
    )
    return turns.join(before, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.concat(
            "text", F.lit("\n\n"), F.coalesce(quote, F.lit("")), F.lit("Regards   \t\n\n\n-- \n"), "role"
        ).alias("body"),
    )


def model_reply(kind: Column, text: Column) -> Column:
    """A model reply about ``text`` of one of twelve kinds, most of them faulty."""

    def reply(summary: Column, action: str, deadline: str | None, tone: str) -> Column:
        return F.to_json(
            F.struct(
                summary.alias("summary"),
                F.lit(action).alias("action_required"),
                F.lit(deadline).cast("string").alias("deadline"),
                F.lit(tone).alias("tone"),
            ),
            {"ignoreNullFields": "false"},
        )

    good = reply(text, "fyi", "2024-02-29", "neutral")
    kinds = [
        good,
        reply(F.lit(""), "none", None, "neutral"),
        reply(text, "answer by post", None, "neutral"),
        reply(text, "reply", None, "warm"),
        reply(text, "reply", "next Tuesday", "neutral"),
        reply(text, "reply", "2023-02-29", "neutral"),
        F.lit('{"summary":7,"action_required":"none","deadline":null,"tone":"neutral"}'),
        F.concat(good, F.lit(" done")),
        F.lit(None).cast("string"),
        reply(text, "none", None, "heated"),
        reply(text, "action", "", "heated"),
        reply(text, "action", "2025-6-30", "neutral"),
    ]
    chosen = F.when(kind == 0, kinds[0])
    for number, raw in enumerate(kinds[1:], 1):
        chosen = chosen.when(kind == number, raw)
    return chosen
