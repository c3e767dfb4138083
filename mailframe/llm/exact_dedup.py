"""Exact dedup by content sort.

Sampled splitters deal normalised texts to ranges, an external sort inside each range places equals
next to each other, and one streaming pass compares neighbours in full. The sort key is a bounded
head of the text, its 64-bit hash and the id, so that splitters stay small and a text that a third
of all rows share spreads over many ranges. Groups that cross a range border are put together from
the first and last run of each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import lower_ascii

HEAD = 24
RUN_SCHEMA = (
    "doc_id long, run_id string, run_keep long, run_size long, text_sha256 string, edge_text string"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("run_id", pa.string()), ("run_keep", pa.int64()),
        ("run_size", pa.int64()), ("text_sha256", pa.string()), ("edge_text", pa.string()),
    ]
)
FLUSH_ROWS = 4096


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted range; memory is one batch and the ids of the open run.

    The first and the last run may go on in the neighbouring ranges: their first row carries the
    text, all others carry none.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    ids: list[int | None] = []
    text: str | None = None
    number = 0

    def close(edge: bool) -> None:
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        run = f"{part}:{number}"
        out.extend((i, run, keep, len(ids), sha, None) for i in ids)
        if edge:
            first = out[-len(ids)]
            out[-len(ids)] = (*first[:5], text)

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )

    for batch in batches:
        for doc_id, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if norm != text:
                if text is not None:
                    close(edge=number == 0)
                    number += 1
                    ids.clear()
                text = norm
            ids.append(doc_id)
            if len(out) >= FLUSH_ROWS:
                yield flush()
    if text is not None:
        close(edge=True)
    if out:
        yield flush()


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest id stays. Rows without an id belong to their group and are kept only where
    no row of the group has one (keep_id is then null). Repeated rows of the largest id all count as
    kept. An empty table gives no rows.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash")
    )
    runs = (
        keyed.repartitionByRange(parts, "head", "hash", "doc_id")
        .sortWithinPartitions("head", "hash", "norm", "doc_id")
        .select("doc_id", "norm")
        .mapInArrow(_runs, RUN_SCHEMA)
    )
    runs = stage(runs, "exact-runs")
    # Two runs per range at most, so this table is bounded by the number of partitions.
    edges = runs.where("edge_text is not null").select("run_id", "run_keep", "run_size", "edge_text")
    whole = edges.groupBy("edge_text").agg(
        F.max("run_keep").alias("keep"), F.sum("run_size").alias("size"), F.collect_list("run_id").alias("run_ids")
    )
    whole = whole.select(F.explode("run_ids").alias("run_id"), "keep", "size")
    joined = runs.drop("edge_text").join(F.broadcast(whole), "run_id", "left")
    keep = F.when(F.col("size").isNull(), F.col("run_keep")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", "run_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
