"""Summarise a corpus of mail and text files and report on the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.replies import with_lint
from mailframe.operators.model import ClientFactory, pick_attempt, summarize
from mailframe.session import stage
from mailframe.sources.corpus import parse_corpus

_RECORD = ["path", "from_display", "subject", "has_attachment", "truncated", "body_text",
           "parse_error"]


def summarize_corpus(
    files: DataFrame,
    factory: ClientFactory,
    language: str = "fr",
    body_limit: int = fixed.BODY_CHAR_LIMIT,
    timeout: float = fixed.MODEL_TIMEOUT_SECONDS,
    parallelism: int | None = None,
    in_flight: int = 1,
) -> DataFrame:
    """One record per file of ``scan_corpus``; unreadable files are records with parse_error.

    ``run_report`` gives the totals and ``write_records`` the JSON lines of the result.
    """
    parsed = stage(parse_corpus(files, body_limit), "corpus")
    readable = parsed.where("parse_error is null")
    answers = pick_attempt(
        summarize(readable, factory, ["path"], language, timeout, parallelism, in_flight=in_flight)
    ).select("path", "model", "raw_response", "latency_ms", "retried")
    answered = parsed.join(answers, "path", "left")
    done = with_lint(answered, "model.text", "model.status", "model.err", "truncated")
    unread = F.col("parse_error").isNotNull()
    return done.select(
        *_RECORD,
        "model",
        F.col("model.status").alias("status"),
        "raw_response",
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
        F.coalesce("retried", F.lit(False)).alias("retried"),
        F.when(unread, F.array().cast("array<string>")).otherwise(F.col("checks")).alias("checks"),
    )
