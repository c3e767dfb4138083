"""Where an original message is archived, and the insert-only archive table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.text import safe_name
from mailframe.operators.dedupe import first_per_key
from mailframe.schemas import MESSAGE_KEY

_ARRIVAL = ["uid_validity", "uid"]


def archive_month(received_local: Column | str) -> Column:
    """``YYYY/MM`` on the clock of the message's own date header, not of UTC."""
    return F.date_format(received_local, fixed.ARCHIVE_MONTH)


def base_path(
    received_local: Column | str, message_id: Column | str, uid: Column | str, prefix: Column | str | None = None
) -> Column:
    """``YYYY/MM/<safe id>.eml``; a message without a usable id is named after its uid."""
    name = F.coalesce(safe_name(message_id), F.concat(F.lit("uid-"), F.col(uid).cast("string")))
    parts = [archive_month(received_local), F.concat(name, F.lit(".eml"))]
    if prefix is not None:
        parts.insert(0, F.col(prefix) if isinstance(prefix, str) else prefix)
    return F.concat_ws("/", *parts)


def archive_paths(
    df: DataFrame,
    archived: DataFrame | None = None,
    arrival: list[str] | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """Add ``base_path`` and ``raw_path`` to rows with received_local, message_id, uid and sha.

    The first bytes to arrive under a base path own it; other bytes get the base path plus the
    start of their SHA-256, equal bytes share one path. ``sha`` is the hash of the original, so
    the bytes themselves stay out of the shuffle. The owner of a base path is a map-side combined
    minimum; ``archived`` (raw_path, base_path, sha) takes precedence over the batch.
    """
    arrival = arrival or _ARRIVAL
    based = df.withColumn("base_path", base_path("received_local", "message_id", "uid", prefix))
    owner = based.groupBy("base_path").agg(
        F.min(F.struct(*arrival, "sha"))["sha"].alias("_owner")
    )
    if archived is not None:
        taken = archived.where("raw_path = base_path").select("base_path", F.col("sha").alias("_old"))
        owner = owner.join(taken, "base_path", "left").select(
            "base_path", F.coalesce("_old", "_owner").alias("_owner")
        )
    alternate = F.concat(
        F.regexp_replace("base_path", r"\.eml\z", "-"),
        F.left(F.col("sha"), F.lit(fixed.ARCHIVE_HASH_HEX)),
        F.lit(".eml"),
    )
    return (
        based.join(owner, "base_path", "left")
        .withColumn(
            "raw_path", F.when(F.col("sha") == F.col("_owner"), F.col("base_path")).otherwise(alternate)
        )
        .drop("_owner")
    )


def new_archive_rows(
    paths: DataFrame, raw: DataFrame, archived: DataFrame, arrival: list[str] | None = None
) -> DataFrame:
    """Archive rows not stored yet, one per path; fails where one path would hold two contents.

    Only keys and hashes are compared. The bytes join last, for the rows that are really new.
    """
    arrival = arrival or _ARRIVAL
    month = F.regexp_extract("raw_path", r"(\d{4})/(\d{2})/[^/]*\z", 1)
    day = F.regexp_extract("raw_path", r"(\d{4})/(\d{2})/[^/]*\z", 2)
    keyed = paths.withColumn("year", month).withColumn("month", day)
    one_sha = keyed.groupBy("raw_path").agg(F.min("sha").alias("_lo"), F.max("sha").alias("_hi"))
    stored = archived.select("year", "month", "raw_path", F.col("sha").alias("_stored"))
    message = F.concat(F.lit("archive hash collision at "), F.col("raw_path"))
    same = (F.col("_lo") == F.col("_hi")) & (
        F.col("_stored").isNull() | (F.col("_stored") == F.col("sha"))
    )
    fresh = (
        first_per_key(keyed, ["raw_path"], ["mailbox", *arrival])
        .join(one_sha, "raw_path")
        .join(stored, ["year", "month", "raw_path"], "left")
        # One condition both checks and filters, so that a pruned column cannot drop the check.
        .where(
            F.when(same, F.col("_stored").isNull()).otherwise(F.raise_error(message).cast("boolean"))
        )
        .select(*MESSAGE_KEY, "raw_path", "base_path", "sha", "year", "month")
    )
    key = [*MESSAGE_KEY, "sha"]
    content = raw.select(*MESSAGE_KEY, "raw", F.sha2("raw", 256).alias("sha"))
    # One join and, for a message delivered twice, one window on the same keys: where the new rows
    # are too many to broadcast, the bytes are shuffled once for both.
    return first_per_key(fresh.join(content, key), key, ["raw_path"]).select(
        "raw_path", "base_path", "sha", "raw", "year", "month"
    )
