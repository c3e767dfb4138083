"""Parquet tables of a mail store: append-only data, snapshots for cursors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailframe import schemas
from mailframe.operators.incremental import above, live_cursors
from mailframe.session import exists, stage
from mailframe.sources.key_index import KeyIndex


def received_month(c: str = "received_at") -> Column:
    """The partition of a message, and of its marks."""
    return F.date_format(c, "yyyy-MM")


@dataclass(frozen=True)
class MailTables:
    """The tables below one shared root. A missing one reads as empty.

    ``key_buckets``, ``box_buckets`` and ``uid_block`` lay out the key index and the raw log, and stay
    as they are for the life of a store. ``messages`` never holds the original bytes, so scans of it stay small; they are in
    ``archive``. Nothing is overwritten while it is read: tables only grow, and the cursor table
    is a directory per version of which the highest complete one counts.
    """

    spark: SparkSession
    root: str
    key_buckets: int = 64
    box_buckets: int = 64
    uid_block: int = 65_536

    @property
    def known(self) -> KeyIndex:
        return KeyIndex(self.spark, f"{self.root}/known", self.key_buckets)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        if not exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def messages(self) -> DataFrame:
        return self._read("messages", schemas.MESSAGES)

    def append_raw(self, rows: DataFrame) -> None:
        """Raw mail into the log, in folders by bucket of the mailbox and block of uids."""
        placed = rows.select(*schemas.RAW_MAIL.names).withColumns(
            {"box_bucket": self._bucket(), "uid_block": F.floor(F.col("uid") / self.uid_block).cast("bigint")}
        )
        placed.write.mode("append").partitionBy("box_bucket", "uid_block").parquet(f"{self.root}/raw_mail")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("mailbox"), F.lit(self.box_buckets)).cast("int")

    def raw_since(self, cursors: DataFrame, mailbox_state: DataFrame | None = None) -> DataFrame:
        """The raw mail of the log above the cursors, as ``new_since``.

        Every bucket of mailboxes is read from the block of its own lowest live cursor on: an idle
        mailbox widens the scan of its bucket alone, and a bucket without a live one is not read.
        The bounds are literals over folders, at most one pair of numbers for each bucket.
        """
        live = live_cursors(cursors, mailbox_state)
        lows = live.groupBy(self._bucket().alias("bucket")).agg(F.min("last_uid").alias("low")).collect()
        folders = F.lit(False)
        for bucket, low in lows:
            folders |= (F.col("box_bucket") == bucket) & (F.col("uid_block") >= (low + 1) // self.uid_block)
        shape = T.StructType([*schemas.RAW_MAIL, T.StructField("box_bucket", T.IntegerType()), T.StructField("uid_block", T.LongType())])
        log = self._read("raw_mail", shape).where(folders)
        return above(log.select(*schemas.RAW_MAIL.names), live)

    def messages_like(self, batch: DataFrame) -> DataFrame:
        """(message key, message_id) of the stored messages that share a row key or an id with ``batch``.

        The index names them, and the months to look in; it may name a message that a run died
        before storing, so that they are looked up. The list of months is as long as the history
        has months. A store without an index gives all messages.
        """
        keys = ["mailbox", "uid_validity", "uid"]
        found = self.known.matching(batch)
        stored = self.messages().select(*keys, "message_id", "received_month")
        if found is None:
            return stored.drop("received_month")
        found = stage(found, "known-messages")
        months = [r[0] for r in found.select("received_month").distinct().collect()]
        # A message without a time is in a folder of its own.
        of_months = F.col("received_month").isin([m for m in months if m is not None])
        if None in months:
            of_months |= F.col("received_month").isNull()
        of_months = stored.where(of_months).drop("received_month")
        return of_months.join(found.select(*keys).distinct(), keys, "left_semi")

    def archive(self, months: DataFrame | None = None) -> DataFrame:
        """The archive, or only the directories of a table of ``YYYY/MM`` in column ``of``."""
        rows = self._read("archive", schemas.ARCHIVE)
        if months is None:
            return rows
        parts = months.select(F.substring_index("of", "/", 1).alias("year"), F.substring_index("of", "/", -1).alias("month"))
        # Both are folder columns: Spark prunes by the other side's values when it runs.
        return rows.join(parts, ["year", "month"], "left_semi")

    def digest_items(self) -> DataFrame:
        return self._read("digest_items", schemas.DIGEST_ITEMS)

    def digests(self) -> DataFrame:
        """The ledger; a window completed twice by a repeated run counts once."""
        return self._read("digests", schemas.DIGESTS).dropDuplicates(["digest_id"])

    def cursors(self) -> DataFrame:
        versions = T.StructType([*schemas.CURSORS, T.StructField("version", T.LongType())])
        every = self._read("cursors", versions)
        newest = every.agg(F.max("version")).scalar()
        return every.where(F.col("version") == newest).drop("version")

    def next_cursor_version(self) -> int:
        versions = T.StructType([*schemas.CURSORS, T.StructField("version", T.LongType())])
        newest = self._read("cursors", versions).agg(F.max("version")).first()[0]
        return 0 if newest is None else newest + 1

    def append_messages(self, rows: DataFrame) -> None:
        """Append, partitioned by received month so that window bounds prune directories.

        The keys go to the index first. Should the run die in between, the index names messages that
        are not there, which lookups allow for.
        """
        rows = rows.withColumn("received_month", received_month()).select(*schemas.MESSAGES.names)
        keys = [*schemas.MESSAGE_KEY, "message_id", "received_month"]
        new = rows.select(*keys)
        if not self.known.generations():
            new = new.unionByName(self.messages().select(*keys))
        self.known.add(new)
        rows.write.mode("append").partitionBy("received_month").parquet(f"{self.root}/messages")

    def append_archive(self, rows: DataFrame) -> None:
        rows.select(*schemas.ARCHIVE.names).write.mode("append").partitionBy(
            "year", "month"
        ).parquet(f"{self.root}/archive")

    def write_cursors(self, cursors: DataFrame, version: int) -> None:
        """A new snapshot; a repeated batch replaces its own version and no other."""
        cursors.select(*schemas.CURSORS.names).write.mode("overwrite").parquet(
            f"{self.root}/cursors/version={version}"
        )

    def complete_digest(self, items: DataFrame, ledger: DataFrame) -> None:
        """Marks first, ledger row last: readers only trust marks of a digest in the ledger."""
        items.select(*schemas.DIGEST_ITEMS.names).write.mode("append").partitionBy(
            "received_month"
        ).parquet(f"{self.root}/digest_items")
        ledger.select(*schemas.DIGESTS.names).write.mode("append").parquet(f"{self.root}/digests")


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines, a file per task."""
    df.write.mode("errorifexists").json(path)
