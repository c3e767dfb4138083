"""Near-duplicate documents by b-bit MinHash.

Minima of a document's word shingles under many hashes give band keys, by which candidates meet, and
their low bits, packed into a few numbers. Of a candidate pair, counts of equal low bits, corrected for
chance collisions, estimate the similarity; pairs clearly below the threshold go no further, all
others are confirmed on their full shingle sets. Where a family of candidates stays in several
components (texts around one long passage, say), its full sets are compared in tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .linking import families, link, tiles

SHINGLE = 5
# Links need a share of at least LEAST / 100 of common shingles.
LEAST = 75
HASHES, ROWS = 128, 4
BITS = 2
# A pair at the threshold is estimated lower than this once in some hundred thousand times.
ESTIMATE = 0.55
CACHED_WORDS = 300_000
SLAB = 4096
# Documents of one tile where a family is compared in blocks.
TILE_ROWS = 384
SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>, low array<long>"

_RANDOM = np.random.RandomState(5)
_FACTORS = (_RANDOM.randint(0, 2**31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RANDOM.randint(0, 2**31, HASHES).astype(np.uint32)
_WORD_FACTORS = np.array([int(x) * 2 + 1 for x in _RANDOM.randint(2**61, 2**62, SHINGLE)], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's 5-word shingles, in order; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    # The number of words is part of a short sequence's hash.
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out += _mix(w[i : i + len(out)] * _WORD_FACTORS[i])
    return np.unique(_mix(out))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of every hash over a set."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), SLAB):
        np.minimum(out, (x[None, start : start + SLAB] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A signed 64-bit key per band of ROWS minima, different bands never sharing one on purpose."""
    key = np.arange(1, HASHES // ROWS + 1, dtype=np.uint64)
    for column in low.reshape(-1, ROWS).astype(np.uint64).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The low BITS of every minimum, packed into signed 64-bit numbers."""
    lanes = 64 // BITS
    kept = (_mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, lanes)
    return (kept << (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, sets, bands, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingle_set(text, hashes)
            low = minima(found)
            sizes.append(len(found))
            sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            bands.append(band_keys(low) if len(found) else np.empty(0, np.int64))
            bits.append(packed_bits(low))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_id", "bands", "low"],
        )


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures: equal lanes less those that agree by chance."""
    lanes = F.lit(0x5555555555555555)
    unlike = F.aggregate(
        F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b)),
        F.lit(0),
        lambda n, d: n + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(lanes)),
    )
    chance = 2.0**-BITS
    return (1 - unlike / HASHES - chance) / (1 - chance)


def _confirmer(documents: DataFrame, classes: DataFrame):
    """Pairs of class representatives that reach the threshold on full sets."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= LEAST * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(linked)), batch.column(1).filter(pa.array(linked))], names=["a", "b"]
            )

    low = classes.select(F.col("rep").alias("node"), "low", F.col("n_shingles").alias("n"))

    def confirm(pairs: DataFrame) -> DataFrame:
        likely = (
            pairs.join(low.toDF("a", "low_a", "n_a"), "a").join(low.toDF("b", "low_b", "n_b"), "b")
            # Sets of too unequal sizes cannot reach the threshold.
            .where(f"100 * least(n_a, n_b) >= {LEAST} * greatest(n_a, n_b)")
            .where(estimate(F.col("low_a"), F.col("low_b")) >= ESTIMATE)
        )
        likely = stage(likely.select("a", "b"), "likely-pairs")
        nodes = stage(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "likely-nodes")
        # Representatives' texts only; of rows that repeat an id, the one with the class's set.
        texts = documents.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text")
        sets = stage(texts.mapInArrow(sets_of, "node long, found binary"), "shingle-sets")
        found = likely.join(sets.toDF("a", "found_a"), "a").join(sets.toDF("b", "found_b"), "b")
        return found.select("a", "b", "found_a", "found_b").mapInArrow(compare, "a long, b long").distinct()

    return confirm


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of intersections of different sets, by products of slabs of the incidence matrix."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(column, np.arange(0, column.max(initial=-1) + 1 + SLAB, SLAB))
    for start, end in zip(edges, edges[1:], strict=False):
        slab = np.zeros((len(sets), SLAB), np.float32)
        slab[owner[start:end], column[start:end] % SLAB] = 1
        out += slab @ slab.T
    return out.astype(np.int64)


def _tile_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links that join the components of two tiles, each component pair once."""
    rows = rows.sort_by("node")
    nodes, parts, names = (rows[c].to_numpy() for c in ("node", "part", "c"))
    sets = [np.frombuffer(x, np.uint64) for x in rows["found"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    common = common_counts(sets)
    near = 100 * common >= LEAST * (sizes[:, None] + sizes[None, :] - common)
    near &= names[:, None] < names[None, :]
    if key[1] != key[2]:
        near &= parts[:, None] != parts[None, :]
    x, y = np.nonzero(near)
    _, first = np.unique(np.stack([names[x], names[y]]), axis=1, return_index=True)
    a, b = nodes[x[first]], nodes[y[first]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _across(documents: DataFrame):
    """Links between components of one family, on full sets and in tiles."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, hashes).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["node", "c", "found"]
            )

    def links(rows: DataFrame) -> DataFrame:
        family = stage(families(rows), "families")
        # Written first, so that Spark plans the join by their size, not by that of all rows of their buckets:
        # unless they are very many, no text is shuffled.
        nodes = stage(rows.select("node", "c").distinct(), "mixed-nodes")
        texts = documents.join(nodes, F.col("doc_id") == F.col("node")).select("node", "c", "text")
        sets = stage(texts.mapInArrow(sets_of, "node long, c long, found binary").distinct(), "mixed-sets")
        met = tiles(family, TILE_ROWS).join(sets, "node")
        return met.groupBy("family", "i", "j").applyInArrow(_tile_links, "a long, b long").distinct()

    return links


def near_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts that are null, empty or blank have no shingles and link with nothing. Equal sets are one
    class, tested once. ``component_id`` is the smallest id reachable over links, and the row with
    that id is kept. Rows without an id link with nothing and are kept, their component null. Rows
    that repeat an id get the component of all of them. No rows give none.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(texts.mapInArrow(_sign, SIGNED), "near-signatures")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(
        linked.groupBy("set_id").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("low").alias("low"),
        ),
        "near-classes",
    )
    buckets = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("node"))
    found = stage(link(buckets, _confirmer(texts, classes), _across(texts)), "near-components")
    of_class = classes.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("set_id").alias("class_id"), F.coalesce("component", "rep").alias("component")
    )
    rows = signed.select("doc_id", "n_shingles", "set_id").join(
        of_class, (F.col("set_id") == F.col("class_id")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left"
    )
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The document with the smallest id of each group, and all that link with nothing, with all columns.

    Rows that repeat the kept id all stay; rows without an id stay.
    """
    gone = stage(near_groups(documents).where("not kept").select("doc_id").distinct(), "near-copies")
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
