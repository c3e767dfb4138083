"""Sender allowlist, outcome of one message, counters of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.text import null_to_empty, trim_space


def normalize_sender(c: Column | str) -> Column:
    return F.lower(trim_space(null_to_empty(c)))


def split_allowlist(text: str | None) -> list[str]:
    """A comma-separated setting as entries."""
    return [part for part in (p.strip().lower() for p in (text or "").split(",")) if part]


def flag_scope(
    df: DataFrame, allowlist: list[str] | DataFrame | None, sender: str = "from_addr"
) -> DataFrame:
    """Add ``in_scope``. An empty allowlist puts every message in scope; no row is dropped.

    A table of entries may be large, so it is joined without a hint: Spark broadcasts it only when
    its size allows.
    """
    if allowlist is None:
        allowlist = []
    if isinstance(allowlist, list):
        # As a literal, the list has a size that Spark knows and broadcasts by.
        entries = F.array(*(F.lit(part) for text in allowlist for part in text.split(","))).cast("array<string>")
        allowlist = df.sparkSession.range(1).select(F.explode(entries).alias("addr"))

    entry = allowlist.columns[0]
    allowed = (
        allowlist.select(normalize_sender(entry).alias("_sender"))
        .where("_sender <> ''")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    nothing_listed = allowed.agg(F.count("*") == 0).scalar()
    return (
        df.withColumn("_sender", normalize_sender(sender))
        .join(allowed, "_sender", "left")
        .withColumn("in_scope", nothing_listed | F.coalesce("_hit", F.lit(False)))
        .drop("_sender", "_hit")
    )


def route_outcome(df: DataFrame, model: str = "model") -> DataFrame:
    """Add the stored outcome of every message; the first rule that applies wins.

    Reads ``parse_error``, ``in_scope`` and the model's summary struct. A message that could not
    be read stays in scope, so that it shows up in the digest.
    """
    unread = F.coalesce(F.col("parse_error"), F.lit("")) != ""
    outside = ~F.col("in_scope")
    none = F.lit(None).cast("string")
    outcome = (
        F.when(
            unread,
            F.struct(
                F.lit(fixed.FAILED_SUMMARY).alias("summary"),
                none.alias("action_req"),
                none.alias("deadline"),
                none.alias("tone"),
                F.lit(True).alias("in_scope"),
                F.lit("error").alias("llm_status"),
                F.concat(F.lit(fixed.PARSE_ERROR_PREFIX), F.col("parse_error")).alias("llm_error"),
            ),
        )
        .when(
            outside,
            F.struct(
                F.lit(fixed.OUT_OF_SCOPE_SUMMARY).alias("summary"),
                F.lit(fixed.ACTIONS[0]).alias("action_req"),
                none.alias("deadline"),
                F.lit(fixed.TONES[0]).alias("tone"),
                F.lit(False).alias("in_scope"),
                F.lit("ok").alias("llm_status"),
                none.alias("llm_error"),
            ),
        )
        .otherwise(
            F.struct(
                F.col(f"{model}.text").alias("summary"),
                F.col(f"{model}.action").alias("action_req"),
                F.nullif(F.col(f"{model}.deadline"), F.lit("")).alias("deadline"),
                F.col(f"{model}.tone").alias("tone"),
                F.lit(True).alias("in_scope"),
                F.coalesce(F.nullif(F.col(f"{model}.status"), F.lit("")), F.lit("ok")).alias(
                    "llm_status"
                ),
                F.nullif(F.col(f"{model}.err"), F.lit("")).alias("llm_error"),
            ),
        )
    )
    kept = [c for c in df.columns if c not in ("in_scope", model)]
    return df.select(*kept, outcome.alias("_out")).select(*kept, "_out.*")


def poll_counts(df: DataFrame) -> DataFrame:
    """Counters per mailbox over all fetched rows; a duplicate counts only as a duplicate."""
    fresh = ~F.col("is_duplicate")
    return df.groupBy("mailbox").agg(
        F.count("*").alias("fetched"),
        F.count_if(fresh).alias("processed"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(fresh & (F.col("llm_status") == "error")).alias("errors"),
        F.count_if(fresh & ~F.col("in_scope")).alias("out_of_scope"),
    )


def batch_counts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``poll_counts`` of a batch and the rows stored from it: all others were duplicates."""
    fetched = batch.groupBy("mailbox").agg(F.count("*").alias("_all"))
    done = poll_counts(stored.withColumn("is_duplicate", F.lit(False)))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("processed", "errors", "out_of_scope")}
    return fetched.join(done, "mailbox", "left").select(
        "mailbox",
        F.col("_all").alias("fetched"),
        zero["processed"],
        (F.col("_all") - F.coalesce("processed", F.lit(0))).alias("duplicates"),
        zero["errors"],
        zero["out_of_scope"],
    )
