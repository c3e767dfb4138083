"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
# They are also those at which bytes.split() splits.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    bucket = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(bucket == 0, F.lit(False))


def fresh(base: str, taken: Iterable[str]) -> str:
    """A column name that differs from all of ``taken`` in any letter case."""
    names = {name.lower() for name in taken}
    while base.lower() in names:
        base += "_"
    return base


def blocks(texts: list[str | None], letters: int) -> Iterator[slice]:
    """Consecutive texts of about so many characters together; a longer text is a block alone."""
    start = size = 0
    for row, text in enumerate(texts):
        if row > start and size + len(text or "") > letters:
            yield slice(start, row)
            start, size = row, 0
        size += len(text or "")
    if texts:
        yield slice(start, len(texts))


def hash_order(*keys: Column) -> Column:
    """A reproducible pseudo-random order of keys."""
    return F.xxhash64(*keys)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label): a bounded training sample, never of held-out rows.

    At most ``per_class`` documents of each label, those with the lowest hash of their id, so that
    reruns agree. Ids are chosen on the narrow label table; only then are their texts read. Of
    repeated labels of one id the largest counts, of repeated texts the smallest; a null text is
    empty.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    order = [hash_order(F.col("doc_id")), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(per_class).union(
        known.where("label = 1").orderBy(*order).limit(per_class)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class pairs of numbers, so a broadcast that does not grow with the data.
    return (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
    )
