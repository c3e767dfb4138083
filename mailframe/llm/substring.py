"""Substring dedup by recompression.

Words get names; in rounds, runs of one name and then pairs of a left-class and a right-class name
are replaced by new names, which hashes of what they replace make the same in every task. What a
symbol became depends on a few words around it only, its context, so equal stretches get equal symbols
inside. Every window takes the highest symbol whose context it holds; a Spark round counts these
names over all documents, and only windows whose symbol occurs in several documents go on to the
second round, which compares windows as a whole and gives each its first document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stage
from .common import blocks

WINDOW = 13
# Texts of so many characters are laid end to end and recompressed at once; a longer one alone.
BLOCK = 1_000_000
CACHED_WORDS = 200_000

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordNames(dict):
    """The names of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def lay_out(texts: list[list[bytes]], names: WordNames) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words with a wall before, between and after texts; walls; start of each text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    out = np.empty(int(sizes.sum()) + len(sizes) + 1, np.uint64)
    wall = np.zeros(len(out), bool)
    wall[0] = wall[-1] = True
    wall[starts - 1] = True
    # Walls differ from each other, so that none is part of a run.
    out[wall] = _mix(np.arange(int(wall.sum()), dtype=np.uint64))
    out[~wall] = np.fromiter(map(names.__getitem__, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    return out, wall, starts


def grams(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A name and a check of every stretch of ``size`` words, put together from halves."""
    span = 1
    while 2 * span < size:
        names = _mix(names[:-span] * _A + names[span:] * _B)
        span *= 2
    left, right = names[: len(names) - (size - span)], names[size - span :]
    return _mix(left * _A + right * _B), (_mix(left * _C + right * _D) >> np.uint64(33)).astype(np.int32)


def symbol_order(names: np.ndarray, wall: np.ndarray, context: int) -> np.ndarray:
    """For every word, how early the best symbol comes whose context begins there; lower is better.

    Symbols of higher rounds come first, then those of smaller hashes. Only symbols whose context is
    no longer than ``context`` words count; the word itself always does.
    """
    size = len(names)
    order = (_mix(names ^ _C) >> np.uint64(4)) | (np.uint64(15) << np.uint64(60))
    low, high = np.arange(size), np.arange(1, size + 1)
    # A context about doubles with every round.
    for turn in range(1, max(context.bit_length() - 2, 1) + 1):
        # Runs of one name. That a run ends where it does depends on its neighbours.
        start = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        length = np.diff(np.append(start, len(names))).astype(np.uint64)
        last = np.append(start[1:], len(names)) - 1
        names = np.where(length > 1, _mix(names[start] * _B + length), names[start])
        low, high = low[np.maximum(start - 1, 0)], high[np.minimum(last + 1, len(high) - 1)]
        wall = wall[start]
        # Pairs of a left and a right name. They cannot overlap, and the classes alone decide.
        side = (_mix(names ^ _mix(np.full(1, turn, np.uint64))) & np.uint64(1)).astype(bool)
        left, right = ~side & ~wall, side & ~wall
        paired = np.append(left[:-1] & right[1:], False)
        second = np.append(False, paired[:-1])
        after, before = np.append(high[1:], high[-1]), np.append(low[:1], low[:-1])
        high = np.where(left, after, high)
        low = np.where(right & ~second, before, low)
        made = _mix(names * _A + np.append(names[1:], names[:1]) * _B)
        names = np.where(paired, made, names)[~second]
        low, high, wall = low[~second], high[~second], wall[~second]
        fits = np.flatnonzero(high - low <= context)
        np.minimum.at(order, low[fits], (_mix(names[fits] ^ _C) >> np.uint64(4)) | (np.uint64(15 - turn) << np.uint64(60)))
    return order


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of ``width`` values, where its least one is; of equal ones the leftmost."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        one, other = best[:-step], best[step:]
        best = np.where(values[other] < values[one], other, one)
        span += step
    return best


def _windows(names: np.ndarray, wall: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that hold no wall, and the name of the symbol that each takes.

    The name covers half a window of words from the start of the symbol's context.
    """
    context = max(window // 2, 1)
    order = symbol_order(names, wall, context)
    if len(names) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = leftmost_least(order, window - context + 1)[: len(names) - window + 1]
    walls = np.append(0, np.cumsum(wall))
    starts = np.flatnonzero(walls[window:] == walls[:-window])
    return starts, grams(names, context)[0][at[starts]].view(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the texts of a batch, block by block, with the number of a block's first row."""
    texts = batch.column(2).to_pylist()
    for block in blocks(texts, BLOCK):
        yield block.start, [text.encode("utf-8", "surrogatepass").split() for text in texts[block]]


def _symbols(window: int):
    """The distinct symbols that the windows of each document take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            for first, texts in _blocks(batch):
                laid, wall, begin = lay_out(texts, names)
                starts, keys = _windows(laid, wall, window)
                owner = np.searchsorted(begin, starts, "right") - 1
                # Neighbouring windows mostly take the same symbol.
                new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)]
                owner, keys = owner[new], keys[new]
                order = np.lexsort((keys, owner))
                owner, keys = owner[order], keys[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)]
                rows = pa.array(owner[new] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys[new])],
                    names=["doc_id", "version", "symbol"],
                )

    return run


def _shared_windows(window: int):
    """Windows whose symbol several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            symbols = batch.column(3)
            for first, texts in _blocks(batch):
                laid, wall, begin = lay_out(texts, names)
                starts, keys = _windows(laid, wall, window)
                owner = np.searchsorted(begin, starts, "right") - 1
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                keep = [
                    ends[i] + np.flatnonzero(np.isin(keys[ends[i] : ends[i + 1]], symbols[first + i].values.to_numpy()))
                    for i in range(len(texts))
                ]
                keep = np.concatenate(keep)
                starts, owner = starts[keep], owner[keep]
                key, check = grams(laid, window)
                rows = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array((starts - begin[owner]).astype(np.int32)),
                        pa.array(key[starts].view(np.int64)), pa.array(check[starts]),
                    ],
                    names=["doc_id", "version", "start", "key", "check"],
                )

    return run


def _numbered(documents: DataFrame) -> DataFrame:
    """(doc_id, version, text) of rows; the version tells rows that repeat an id apart by their texts."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = ids.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Mostly no id repeats, and rows of the later steps are shorter without a hash of the text.
    version = F.lit(0) if repeats.isEmpty() else F.hash("text")
    return ids.select("doc_id", version.alias("version"), "text")


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, version, starts): the windows of a document that a document of a smaller id holds too.

    Takes (doc_id, version, text). Starts count words from 0. Rows that repeat an id have no smaller id
    than each other. Rows without an id have no place in the order and take no part. Documents
    without such a window have no row.

    The tables that are looked up hold each name of the looked-up rows once, so that a task's share
    of them is never larger than its share of the rows: they are hashed, and nothing is sorted.
    """
    texts = texts.where("doc_id is not null")
    spark, document = texts.sparkSession, ["doc_id", "version"]
    with scratch(spark, "substring") as keep:
        with scratch(spark, "symbols") as keep_symbols:
            held = keep_symbols(texts.mapInArrow(_symbols(window), "doc_id long, version int, symbol long"), "symbols")
            # One row per document and symbol, so a count above one is a second document.
            shared = held.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol")
            marked = held.join(shared.hint("shuffle_hash"), "symbol", "left_semi").groupBy(*document)
            marked = keep(marked.agg(F.collect_set("symbol").alias("symbols")), "shared")
        windows = texts.join(marked.hint("shuffle_hash"), document).select(*document, "text", "symbols")
        shape = "doc_id long, version int, start int, key long, check int"
        windows = keep(windows.mapInArrow(_shared_windows(window), shape), "windows")
        first = windows.groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first = keep(first.where("first < last").select("key", "check", "first"), "first")
        later = windows.join(first.hint("shuffle_hash"), ["key", "check"]).where("doc_id > first").groupBy(*document)
        return stage(later.agg(F.collect_set("start").alias("starts")), "repeats")


def drop_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by spaces).

    A word goes where a window of ``window`` consecutive words covers it that also starts in a document
    of a smaller id, as both were before anything went. Words are separated by ASCII white space. A
    null or empty text has no words, a text shorter than a window loses none, and a long one is read
    whole. Of rows that repeat an id none counts as the earlier one; rows without an id lose
    nothing and cost no other row anything. No rows give none.
    """
    texts = _numbered(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                if starts.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    change[at] += 1
                    change[at + window] -= 1
                    words = [w for w, covered in zip(words, np.cumsum(change).tolist(), strict=False) if not covered]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    repeats = repeated_windows(texts, window)
    rows = texts.join(repeats.hint("shuffle_hash"), ["doc_id", "version"], "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
