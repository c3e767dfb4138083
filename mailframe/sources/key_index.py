"""An index of stored message keys: hash buckets, and a Bloom filter for every few thousand keys.

A poll asks which of its keys are stored. Bitmaps of the buckets its keys fall into answer for
nearly all of them, and key files are opened only of buckets that may hold a hit. Keys are
added in generations that are merged when they become many, so that a lookup tests a bounded
number of bitmaps per key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mailframe.schemas import MESSAGE_KEY
from mailframe.session import exists, scratch, stage

# Fixed value: the bits of a bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768
# With so many keys a bitmap and four probes, one absent key in a hundred looks present.
KEYS_PER_BITMAP = 3_000
PROBES = 4
KEYS_PER_FILE = 2_000_000
# Generations are merged beyond this number.
GENERATIONS = 8
LIVE = "generation string, n long, blocks int"


def row_and_id_keys(rows: DataFrame, *more: str) -> DataFrame:
    """(kind, hash, mailbox, uid_validity, uid, message_id): a row key each, and an id key where there is an id."""
    row_hash = F.xxhash64(F.lit("row"), *MESSAGE_KEY)
    id_hash = F.when(F.col("message_id") != "", F.xxhash64(F.lit("id"), "mailbox", "message_id"))
    both = F.array(
        F.struct(F.lit("row").alias("kind"), row_hash.alias("hash")),
        F.struct(F.lit("id").alias("kind"), id_hash.alias("hash")),
    )
    exploded = rows.select(*MESSAGE_KEY, "message_id", *more, F.explode(both).alias("_k"))
    return exploded.where("_k.hash is not null").select("_k.kind", "_k.hash", *MESSAGE_KEY, "message_id", *more)


def _probe(number: int) -> Column:
    return F.pmod(F.xxhash64("hash", F.lit(number)), F.lit(BITMAP_BITS))


def _bit(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0


def _block(blocks: Column) -> Column:
    return F.pmod(F.shiftright("hash", 20), blocks).cast("int")


@dataclass(frozen=True)
class KeyIndex:
    """The index below ``root``. Entries may exceed the stored rows, never fall short of them.

    ``buckets`` is fixed for an index: a hit opens one bucket, so choose it for the size that the
    store will have. It also bounds what a lookup brings to the driver. A generation is live once the newest version of the list of generations names it.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    def _versions(self) -> DataFrame:
        if not exists(self.spark, f"{self.root}/live"):
            return self.spark.createDataFrame([], f"{LIVE}, version long")
        return self.spark.read.schema(f"{LIVE}, version long").parquet(f"{self.root}/live")

    def generations(self) -> list[Row]:
        """The live generations, a handful of rows."""
        rows = self._versions()
        newest = rows.agg(F.max("version")).scalar()
        return rows.where(F.col("version") == newest).orderBy("n", "generation").collect()

    def _publish(self, live: list[tuple]) -> None:
        newest = self._versions().agg(F.max("version")).first()[0]
        version = 0 if newest is None else newest + 1
        rows = self.spark.createDataFrame(live, LIVE).coalesce(1)
        rows.write.parquet(f"{self.root}/live/version={version}")

    def _write(self, keys: DataFrame, n: int) -> tuple:
        """One generation: key files by bucket, and the bitmaps of each bucket's blocks."""
        generation = uuid.uuid4().hex
        blocks = max(1, -(-n // (self.buckets * KEYS_PER_BITMAP)))
        files = max(1, -(-n // (self.buckets * KEYS_PER_FILE)))
        part = F.pmod(F.shiftright("hash", 40), F.lit(files))
        (
            keys.repartition("bucket", part)
            .sortWithinPartitions("bucket", "hash")
            .write.partitionBy("bucket")
            .parquet(f"{self.root}/{generation}/keys")
        )
        bits = keys.select("bucket", _block(F.lit(blocks)).alias("block"), F.explode(F.array(*map(_probe, range(PROBES)))).alias("bit"))
        bitmaps = bits.groupBy("bucket", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        bitmaps.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{generation}/bitmaps")
        return generation, n, blocks

    def _keys_of(self, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation}/keys")

    def add(self, rows: DataFrame) -> None:
        """Add rows (message key, message_id, received_month); to be called before they are stored.

        Where that leaves too many generations, the small ones become one. Keys are copied by a
        merge only into a generation that is larger by half at least, so that each is copied a
        number of times that grows with the logarithm of the index.
        """
        live = [tuple(r)[:3] for r in self.generations()]
        with scratch(self.spark, "known-keys") as keep:
            keys = row_and_id_keys(rows, "received_month")
            keys = keep(keys.withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int")), "keys")
            n = keys.count()
            if not n:
                return
            live.append(self._write(keys, n))
        if len(live) > GENERATIONS:
            live.sort(key=lambda g: g[1])
            size, total = 1, live[0][1]
            while size < len(live) and (size < 2 or live[size][1] <= 2 * total):
                total += live[size][1]
                size += 1
            merged = reduce(DataFrame.unionByName, [self._keys_of(g[0]) for g in live[:size]])
            live = [self._write(merged, total), *live[size:]]
        self._publish(live)

    def candidates(self, batch: DataFrame) -> DataFrame:
        """(generation, bucket, and the key columns): keys of ``batch`` that the bitmaps do not rule out."""
        live = self.generations()
        keys = row_and_id_keys(batch.select(*MESSAGE_KEY, "message_id"))
        # An id shared by a third of the batch is one question.
        own = [F.when(F.col("kind") == "row", F.col(c)).alias(c) for c in ("uid_validity", "uid")]
        named = F.when(F.col("kind") == "id", F.col("message_id")).alias("message_id")
        asked = keys.select("kind", "hash", "mailbox", *own, named).distinct()
        asked = stage(asked.withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int")), "asked-keys")
        touched = [r.bucket for r in asked.select("bucket").distinct().collect()]
        bitmaps = [
            self.spark.read.parquet(f"{self.root}/{g.generation}/bitmaps")
            .where(F.col("bucket").isin(touched)).withColumn("generation", F.lit(g.generation))
            for g in live
        ]
        places = F.array(*(F.struct(F.lit(g.generation).alias("generation"), F.lit(g.blocks).alias("blocks")) for g in live))
        placed = asked.withColumn("_g", F.explode(places)).select(*asked.columns, "_g.generation", _block(F.col("_g.blocks")).alias("block"))
        tested = placed.join(reduce(DataFrame.unionByName, bitmaps), ["generation", "bucket", "block"])
        may_hold = reduce(lambda x, y: x & y, [_bit(F.col("bitmap"), _probe(i)) for i in range(PROBES)])
        return tested.where(may_hold).select("generation", *asked.columns)

    def matching(self, batch: DataFrame) -> DataFrame | None:
        """(message key, message_id, received_month) of entries that share a key with ``batch``.

        None where nothing has been indexed. Of each generation only the buckets with a candidate
        are read, as folders that Spark prunes by literals: at most ``buckets`` numbers.
        """
        if not (live := self.generations()):
            return None
        maybe = stage(self.candidates(batch), "candidate-keys")
        opened: dict[str, list[int]] = {}
        for row in maybe.select("generation", "bucket").distinct().collect():
            opened.setdefault(row.generation, []).append(row.bucket)
        parts = [self._keys_of(g.generation).where(F.col("bucket").isin(opened.get(g.generation, []))) for g in live]
        stored = reduce(DataFrame.unionByName, parts)
        wanted = maybe.drop("generation", "bucket").distinct().withColumnsRenamed(
            {"uid_validity": "_epoch", "uid": "_uid", "message_id": "_id"}
        )
        same = F.when(
            F.col("kind") == "row", (F.col("uid_validity") == F.col("_epoch")) & (F.col("uid") == F.col("_uid"))
        ).otherwise(F.col("message_id") == F.col("_id"))
        found = stored.join(wanted, ["kind", "hash", "mailbox"]).where(same)
        return found.select(*MESSAGE_KEY, "message_id", "received_month").distinct()
