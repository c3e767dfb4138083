"""The poll as a stream: micro-batches through the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mailframe.operators.incremental import new_since
from mailframe.plans.poll import PollSettings, process_batch
from mailframe.sources.tables import MailTables


def ingest_stream(
    source: DataFrame,
    tables: MailTables,
    checkpoint: str,
    settings: PollSettings,
    baselines: DataFrame | None = None,
    on_counts: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the continuous ingest of a ``raw_mail`` stream.

    The checkpoint is the offset: it moves once a micro-batch is stored, so a batch may run again
    and then only finds rows that are already known. Deduplication across batches compares either
    of two keys with the message table, which ``dropDuplicates`` on a stream cannot express.
    ``baselines`` (a cursor table from the first start) skips the backlog: it is fixed, unlike the
    moving cursors, because files need not arrive in uid order. The cursors are still written,
    for batch users of the tables.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        wanted = batch if baselines is None else new_since(batch, baselines)
        counts = process_batch(tables, wanted, settings)
        if on_counts is not None:
            on_counts(counts, batch_id)

    return (
        source.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
