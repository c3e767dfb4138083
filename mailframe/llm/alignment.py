"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes differently. Every token points to the farthest-right token that
overlaps it, and successor doubling over whole arrays takes each token to the terminal of its
component, where tokens of both sides end together. The terminal labels the group. Both tokenizers
cut at every space after a character that is no white space, so a batch's texts are aligned by
their distinct stretches between such spaces, all at once, and stretches met before are looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .bpe import byte_letters
from .common import blocks

# Texts of so many characters are aligned at once; a longer one alone.
BLOCK = 1_000_000
CACHED_STRETCHES = 250_000
CACHED_LETTERS = 20_000_000
# New stretches that are encoded as one text.
ROW_STRETCHES = 2_000
# Pairs of ids in one row of the staged table; a document with more goes on in further rows.
ROW_PAIRS = 65_536
# So many of the most frequent pairs are broadcast; all others are joined by a shuffle.
HOT_PAIRS = 50_000
BLANK = "▁"
# A space after any character that neither tokenizer could take for white space, before a word.
# Fixed value: the splitting rule of the first vocabulary.
WORDS_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Whatever one of the two tokenizers could take for white space, and more.
LOOSE = r"\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁯　﻿"
# A space after any other character, before a word.
CUT = re.compile(rf"(?<=[^{LOOSE}])(?= +[^ ])")
OPEN_END = re.compile(rf"(?:^|[{LOOSE}])\Z")
ALIGNED = (
    "row long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "keys array<long>, times array<long>"
)


def component_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of the tokens of both sides, and how many groups there are.

    Takes the rising byte offsets at which tokens end; both sides cover the same bytes. A token's
    farthest-right overlapping token is the one of the other side that holds its last byte; where
    both end there, that of side b is the terminal.
    """
    n_a, n = len(ends_a), len(ends_a) + len(ends_b)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    own = np.arange(n)
    over_b = np.searchsorted(ends_b, ends_a - 1, "right")
    over_a = np.searchsorted(ends_a, ends_b - 1, "right")
    successor = np.concatenate([n_a + over_b, np.where(ends_a[over_a] > ends_b, over_a, own[n_a:])])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            break
        successor = further
    terminals = np.flatnonzero(successor == own)
    labels = np.searchsorted(terminals, successor)
    return labels[:n_a], labels[n_a:], len(terminals)


def _distinct_in_groups(groups: np.ndarray, ids: np.ndarray, n_groups: int):
    """Distinct (group, id) with their counts, in order, and how many each group has."""
    order = np.lexsort((ids, groups))
    groups, ids = groups[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(ids)))
    return ids[at], times, np.bincount(groups[at], minlength=n_groups)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def group_pairs(groups_a, ids_a, groups_b, ids_b, n_groups: int):
    """(group, id of a, id of b, occurrences) of all linked pairs, each id pair of a group once."""
    a, times_a, sizes_a = _distinct_in_groups(groups_a, ids_a, n_groups)
    b, times_b, sizes_b = _distinct_in_groups(groups_b, ids_b, n_groups)
    group_of_a = np.repeat(np.arange(n_groups), sizes_a)
    fan = sizes_b[group_of_a]
    at_a = np.repeat(np.arange(len(a)), fan)
    at_b = _ranges((np.cumsum(sizes_b) - sizes_b)[group_of_a], fan)
    return np.repeat(group_of_a, fan), a[at_a], b[at_b], times_a[at_a] * times_b[at_b]


def _even(text: str) -> bool:
    """Whether all spaces lie between printable characters, so that any split at spaces is the cut."""
    if text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or "\t " in text:
        return False
    return text.replace("\n", "").replace("\t", "").isprintable()


def _open_end(stretch: str) -> bool:
    """Whether what follows a stretch could change its tokens: it ends in white space, or is empty."""
    return not stretch[-1:].isalnum() and bool(OPEN_END.search(stretch))


@dataclass
class Stretches:
    """Alignments of the stretches met so far, by number; pairs of all of them lie one after another."""

    number: dict[str, int] = field(default_factory=dict)
    letters: int = 0
    shown: list[str] = field(default_factory=list)
    # Columns: tokens of a and of b, groups, links, and whether the bytes come back.
    sizes: np.ndarray = field(default_factory=lambda: np.empty((0, 5), np.int64))
    fans: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


class Aligner:
    """Both tokenizers and the alignments of stretches between spaces."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        # Ids of this vocabulary rise in the order of its merges, so that they are ranks too.
        ranks = {bytes(byte_of[x] for x in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of the first vocabulary do not rise with its merges")
        self.a = tiktoken.Encoding("a", pat_str=WORDS_A, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        # A piece with a space behind a character would let tokens reach over a cut.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.n_ids = max(len(self.bytes_a), len(self.bytes_b))
        self.decimals = [f"{i}{mark}" for mark in ",|;" for i in range(self.n_ids)]
        self.known = Stretches()

    def stretches(self, text: str) -> list[str]:
        """The text, with a space before it, cut into stretches; each is without its first space."""
        if not self.cuts:
            return [text]
        if _even(text):
            return text.split(" ")
        return [x[1:] for x in CUT.split(" " + text)]

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for stretches in a row, or None where the bytes do not come back."""
        text = " " + " ".join(stretches)
        a, b = self.a.encode_ordinary(text), list(chain.from_iterable(self.b.encode(stretches, num_threads=1)))
        whole = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None

    def learn(self, stretches: list[str]) -> None:
        """Align new stretches: in rows where they end in a letter or sign, else each by itself."""
        rows, even = [], []
        for x in stretches:
            (rows if not self.cuts or _open_end(x) else even).append(x)
        rows = [[x] for x in rows] + [even[i : i + ROW_STRETCHES] for i in range(0, len(even), ROW_STRETCHES)]
        found = [part for row in rows for part in self._learn_row(row)]
        known = self.known
        for name, parts in zip(("sizes", "fans", "keys", "times"), zip(*found, strict=True), strict=True):
            setattr(known, name, np.concatenate([getattr(known, name), *parts]))

    def _learn_row(self, stretches: list[str]) -> list[tuple[np.ndarray, ...]]:
        encoded = self._encode(stretches)
        if encoded is None and len(stretches) > 1:
            middle = len(stretches) // 2
            return self._learn_row(stretches[:middle]) + self._learn_row(stretches[middle:])
        known, n = self.known, len(stretches)
        known.letters += sum(map(len, stretches))
        known.number.update(zip(stretches, range(len(known.shown), len(known.shown) + n), strict=True))
        a, b = encoded or (np.empty(0, np.int64), np.empty(0, np.int64))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        stretch_ends = np.cumsum([len(x.encode()) + 1 for x in stretches])
        of_a, of_b, n_groups = component_labels(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(stretch_ends, ends_a), np.searchsorted(stretch_ends, ends_b)
        # Tokens in the order of groups, side a first, each with the mark that follows it.
        place = np.concatenate([2 * of_a, 2 * of_b + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([a, b])[order]
        mark = np.full(len(place), 2)
        mark[:-1] = np.where(place[1:] == place[:-1], 0, np.where(place[1:] // 2 == place[:-1] // 2, 1, 2))
        tokens = list(map(self.decimals.__getitem__, (mark * self.n_ids + ids).tolist()))
        n_a, n_b = np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n)
        start = 0
        for end in np.cumsum(n_a + n_b).tolist():
            known.shown.append("".join(tokens[start:end])[:-1])
            start = end
        group, x, y, times = group_pairs(of_a, a, of_b, b, n_groups)
        owner = np.empty(n_groups, np.int64)
        owner[of_a] = owner_a
        fans = np.bincount(owner[group], minlength=n)
        links = np.bincount(owner[group], weights=times, minlength=n).astype(np.int64)
        fits = np.full(n, encoded is not None, np.int64)
        sizes = np.stack([n_a, n_b, np.bincount(owner, minlength=n), links, fits], axis=1)
        return [(sizes, fans, x * len(self.bytes_b) + y, times)]

    def align(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text: tokens of a and of b, groups, links, digest of groups, linked id pairs and how often."""
        cut = [self.stretches(x) if x else [] for x in texts]
        if len(self.known.number) > CACHED_STRETCHES or self.known.letters > CACHED_LETTERS:
            self.known = Stretches()
        get = self.known.number.get
        numbers = [list(map(get, parts)) for parts in cut]
        new = {x: None for parts, found in zip(cut, numbers, strict=True) if None in found for x, i in zip(parts, found, strict=True) if i is None}
        if new:
            self.learn(list(new))
            numbers = [found if None not in found else list(map(get, parts)) for parts, found in zip(cut, numbers, strict=True)]
        known = self.known
        starts = np.cumsum(known.fans) - known.fans
        for found in numbers:
            at, often = np.unique(np.array(found, np.int64), return_counts=True)
            sizes = known.sizes[at]
            if not len(at) or not sizes[:, 4].all():
                yield 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            shown = ";".join(map(known.shown.__getitem__, found))
            fans = known.fans[at]
            pairs = _ranges(starts[at], fans)
            keys, times = known.keys[pairs], known.times[pairs] * np.repeat(often, fans)
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            yield *(often @ sizes[:, :4]).tolist(), hashlib.sha256(shown.encode()).hexdigest(), keys[first], np.add.reduceat(times, first)


def _align_rows(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = Aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        names = [column.split()[0] for column in ALIGNED.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int64())] * 2]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in blocks(texts, BLOCK):
                out = []
                for doc_id, (*sizes, shown, keys, times) in zip(ids[block], aligner.align(texts[block]), strict=True):
                    for start in range(0, max(len(keys), 1), ROW_PAIRS):
                        part = slice(start, start + ROW_PAIRS)
                        out.append((row, start // ROW_PAIRS, doc_id, *sizes, shown, keys[part], times[part]))
                    row += 1
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def linked_pairs(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of every document: sizes, digest, and its linked id pairs with their occurrences.

    Columns: row (a number of its own for each document), part, doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, keys, times. A key is the id of a times the number of ids of b, plus the id of b.
    A document of very many different pairs goes on in rows of further parts.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_align_rows(path_a, path_b), ALIGNED)


def align_documents(documents: DataFrame, path_a: str, path_b: str, hot: int = HOT_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level BPE file and ``path_b`` a piece model, which every executor has. Texts
    that are null or empty, or that either tokenizer does not give back byte for byte, have no tokens:
    zeros and an empty digest. Texts of any length are aligned whole; what a group links is every
    pair of its two sides, kept as distinct id pairs with their number. Rows that repeat an id are
    documents of their own; no rows give none.

    Pairs are counted over all documents, combined before the shuffle. The ``hot`` most frequent ones
    are broadcast, a bound that does not grow, so that no pair that most documents hold meets in one
    task; all other pairs are joined.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = stage(linked_pairs(documents, path_a, path_b), "aligned")
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.withColumn("a", F.expr(f"key div {size_b}")), "pair-counts")
    # One row per id of the first vocabulary at most.
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    rated = counts.join(F.broadcast(top), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    rated = stage(rated, "rated-pairs")
    frequent = rated.orderBy(F.col("n").desc(), "key").limit(hot)
    held = aligned.select("row", F.explode(F.arrays_zip("keys", "times")).alias("held")).select(
        "row", F.col("held.keys").alias("key"), F.col("held.times").alias("times")
    )
    looked_up = held.join(F.broadcast(frequent), "key", "left")
    rest = looked_up.where("n is null").select("row", "key", "times").join(rated, "key")
    columns = ["row", "times", "n", "best"]
    sums = (
        looked_up.where("n is not null").select(columns).unionByName(rest.select(columns))
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"))
    )
    return aligned.where("part = 0").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
