"""Fuzzy dedup of lines across documents.

Lines are normalised to their words; equal ones are one class. An edit of one word touches two word
pairs at most, so similar lines have some of their rarest word pairs in common, if each names a few more
than the edits allowed can touch; by these candidates meet, and no similar pair is missed. Candidates
are verified by their word edit similarity, and of each connected group of lines the first occurrence
stays.

Word pairs are many more than lines, so they are dealt out and met as packed records, thousands to a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, scratch, stage
from .common import blocks, fresh
from .linking import link_pairs, shared_buckets, tiles_across
from .near_dedup import TILE_ROWS, WordHashes, _mix
from .toxicity import FOLD

# Linked lines may differ in all of 64 bits; how many follows from their lengths, see parted().
DIFFERENT = 64
# Linked lines need this many of 100 words of the longer one in common order.
LEAST = 80
# Slots of the counts of words and of word pairs, a power of 2. Counts only order the pairs.
SLOTS = 1 << 20
# Slots of a row of counts.
SLOT_ROWS = 1 << 14
# Characters that are cut into words together.
LETTERS = 1 << 19
# Word pairs are dealt into so many parts by the low bits of their hash, a power of 2; PACKED of them are sent together.
PARTS, PACKED = 1 << 10, 1 << 18
# Pairs of lines are dealt into so many parts, and MET of them sent together.
PAIR_PARTS, MET = 1 << 8, 1 << 20
# Bytes of named word pairs that are looked at together, unless one part has more.
GATHERED = 1 << 21
# Of a bucket of more lines than WHOLE, or with more than CROWD close pairs a line, its rows go on instead of its pairs.
WHOLE, CROWD = 1 << 14, 16
# Pairs of lines that are looked at together.
SLICE = 1 << 20
SCANNED = "doc_id long, n_lines int, line int, node long, chunk int, low binary, high binary"
# A word pair that a line names: its hash without the bits of the part; in how many buckets the line must meet
# another, its size, its class and the parities of its words. Sizes beyond LONG are LONG.
NAMED = np.dtype([("key", "<u4"), ("need", "u1"), ("size", "<u2"), ("node", "<i8"), ("sim", "<u4")])
LONG = 0xFFFF
# Two lines, in how many buckets they met (255 standing for more) and in how many they must.
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("met", "u1"), ("need", "u1")])
# Parities of a line where many lines are compared, in numbers of 64 bits.
LANES = 16
# Slots of words whose numbers are compared beside them.
COUNTS = 256
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEY_BITS, _RANK_BITS = 40, 8
_BYTES = np.random.RandomState(7).randint(1, 2**63, 256).astype(np.uint64)
_BASE = 0x9FB21C651E98DF25


def line_words(line: str) -> list[bytes]:
    """Lower-cased words without ASCII signs; a line without any is no line to dedup."""
    return line.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


class Lines:
    """The lines with words of texts, in order: ``text`` and ``line`` say where each is, ``nodes`` what it is.

    ``flat`` has a hash for every word, ``sizes`` the number of words of each line; ``totals`` counts all lines
    of each text. Words are hashed by differences of running sums, for all texts at once.
    """

    powers = np.ones((2, 1), np.uint64)

    def __init__(self, texts: list[str]):
        raw = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
        joined = b"\n%s\n" % b"\n".join(raw)
        folded = joined.translate(FOLD)
        letters = np.frombuffer(folded, np.uint8)
        gap = letters == 32
        # Words begin and end in turn, as there is a gap at both ends.
        change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = change[::2], change[1::2]
        powers, inverse = self._powers(len(letters))
        sums = np.cumsum(_BYTES[letters] * powers)
        self.flat = _mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts])
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        sizes = np.diff(np.searchsorted(starts, breaks))
        at = np.flatnonzero(sizes)
        self.sizes = sizes[at]
        self.totals = np.array([text.count(b"\n") + 1 for text in raw], np.int64)
        begin = np.cumsum(self.totals) - self.totals
        self.text = np.repeat(np.arange(len(raw)), self.totals)[at]
        self.line = at - begin[self.text]
        # All words with one space behind each: a line's words are a piece of it.
        kept = ~gap
        kept[1:] |= kept[:-1]
        normal = memoryview(letters[kept].tobytes())
        behind = np.cumsum(ends - starts + 1)
        last = np.cumsum(self.sizes) - 1
        edges = zip(np.append(0, behind[last][:-1]).tolist(), (behind[last] - 1).tolist(), strict=False)
        found = np.fromiter((xxhash.xxh3_64_intdigest(normal[i:j]) for i, j in edges), np.uint64, len(at))
        self.nodes = (found - np.uint64(1 << 63)).view(np.int64)

    @classmethod
    def _powers(cls, n: int) -> np.ndarray:
        """Powers of an odd number and of its inverse, as they are modulo 2 ** 64."""
        if n > cls.powers.shape[1]:
            steps = np.empty((2, max(n, 2 * LETTERS)), np.uint64)
            steps[:, 0], steps[0, 1:], steps[1, 1:] = 1, _BASE, pow(_BASE, -1, 1 << 64)
            cls.powers = np.cumprod(steps, axis=1)
        return cls.powers[:, :n]


def word_pairs(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbours within lines, and the places of their first words."""
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - 1] = False
    first = np.flatnonzero(inside)
    return _mix(flat[first] * _FIRST + flat[first + 1] * _SECOND), first


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _flat(lines: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each line."""
    return np.fromiter((hashes[w] for words in lines for w in words), np.uint64), np.array([len(words) for words in lines])


DESCRIBED = "node long, c long, text string, words int, sims binary, counts binary"


def sim_hashes(lines: list[list[bytes]], hashes: WordHashes, lane: int = 0) -> np.ndarray:
    """64 parities of word counts, for lines of at least one word; a word counts in one of two lanes.

    A word that only one of two lines has changes one bit, so lines differ in no more bits than such words.
    """
    flat, sizes = _flat(lines, hashes)
    bit = np.where((flat >> np.uint64(6)) & np.uint64(1) == lane, np.uint64(1) << (flat & np.uint64(63)), np.uint64(0))
    return np.bitwise_xor.reduceat(bit, np.cumsum(sizes) - sizes).view(np.int64)


def n_keys(sizes: np.ndarray) -> np.ndarray:
    """Pairs of rank that a line of so many words must name to meet once; lines of under 4 words only link with equal ones.

    With k edits, lines of m and m + d words share at least m + d - 1 - 2k of their pairs in number, so the
    shorter, of m - 1 pairs, shares one of its first 2k - d + 1 in any common order. k is at most
    (m + d) * (100 - LEAST) // 100, and d at most k.
    """
    most = np.zeros_like(sizes)
    # More words than allow one more edit only lower the number.
    for more in range(100 // (100 - LEAST) + 1):
        edits = (sizes + more) * (100 - LEAST) // 100
        most = np.where(more <= edits, np.maximum(most, 2 * edits - more + 1), most)
    return np.where((sizes + 1) * (100 - LEAST) >= 100, np.minimum(most, sizes - 1), 0)


def more(sizes: np.ndarray) -> np.ndarray:
    """Pairs that lines name beyond n_keys(), so that those that only have a passage in common do not meet often enough."""
    return np.minimum(sizes // 24 + 1, 200)


class Order:
    """Ranks of word pairs by counts of words and pairs in all texts, the rarest first.

    Pairs are taken for as frequent as their words make likely, and for more frequent if their own slot is
    clearly above the usual one, which many rare pairs share.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        usual = float(np.median(pairs))
        above = np.maximum(pairs - usual - 3 * usual**0.5, 2.0**-30)
        self.pairs = np.clip(4 * (np.log2(above) + 40), 0, 255).astype(np.uint8)
        # Eighths of a power of 2, so that two of them are quarters after halving.
        self.words = np.clip(8 * np.log2(np.maximum(words, 1)), 0, 255).astype(np.uint8)
        self.base = int(4 * (40 - np.log2(max(1, words.sum()))))

    def ranks(self, flat: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
        words = self.words[_slots(flat)].astype(np.int64)
        likely = (words[first] + words[first + 1]) // 2 + self.base
        return np.maximum(np.clip(likely, 0, 255), self.pairs[_slots(pairs)]).astype(np.uint64)


def line_keys(flat: np.ndarray, sizes: np.ndarray, order: Order) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each line's rarest word pairs, more() than it must name: hashes, their lines, and how often these must meet.

    A pair counts once in a line: of its distinct ones no more are missing elsewhere than of all. So a line that
    has some pairs more than it must name shares one and as many more, and if both name these, two similar
    lines meet as often as the one of them must that must less.
    """
    for lines in range(0, len(sizes), 1 << 16):
        some = sizes[lines : lines + (1 << 16)]
        begin = sizes[:lines].sum()
        words = flat[begin : begin + some.sum()]
        pairs, first = word_pairs(words, some)
        line = np.repeat(np.arange(len(some), dtype=np.uint64), some)[first]
        named = (line << np.uint64(_KEY_BITS + _RANK_BITS)) | (order.ranks(words, pairs, first) << np.uint64(_KEY_BITS))
        named |= pairs & np.uint64((1 << _KEY_BITS) - 1)
        named.sort()
        named = named[np.append(True, named[1:] != named[:-1])[: len(named)]]
        line = (named >> np.uint64(_KEY_BITS + _RANK_BITS)).astype(np.int64)
        edges = np.searchsorted(line, np.arange(len(some) + 1))
        least = n_keys(some)
        taken = np.arange(len(line)) - edges[line] < (least + more(some))[line]
        need = np.clip(np.diff(edges) - least, 0, more(some)) + 1
        yield named[taken] & np.uint64((1 << _KEY_BITS) - 1), line[taken] + lines, need[line[taken]]


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    """Rows of SCANNED with counts: a byte for each of SLOT_ROWS slots, and what bytes cannot hold as pairs of a slot and the rest."""
    chunks, lows, highs = [], [], []
    for chunk, some in enumerate(counts.reshape(-1, SLOT_ROWS)):
        if some.any():
            low = np.minimum(some, 255)
            at = np.flatnonzero(some > low)
            chunks.append(chunk)
            lows.append(low.astype(np.uint8).tobytes())
            highs.append(np.stack([at, (some - low)[at]]).astype("<i8").tobytes())
    none = [pa.nulls(len(chunks), kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.int64())]
    return _rows(SCANNED, *none, pa.array(chunks, pa.int32()), pa.array(lows, pa.binary()), pa.array(highs, pa.binary()))


def _rows(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[column.split()[0] for column in schema.split(", ")])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line with words, one with line null for every document, and counts of words and of word pairs."""
    words, pairs = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for some in blocks(texts, LETTERS):
            found, own = Lines(texts[some]), ids[some]
            np.add.at(words, _slots(found.flat), 1)
            np.add.at(pairs, _slots(word_pairs(found.flat, found.sizes)[0]), 1)
            empty = [pa.nulls(len(own) + len(found.text), kind) for kind in (pa.int32(), pa.binary(), pa.binary())]
            no_line = pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.int64())
            yield _rows(
                SCANNED,
                pa.array(np.concatenate([own, own[found.text]]), pa.int64()),
                pa.array(np.concatenate([found.totals, found.totals[found.text]]), pa.int32()),
                pa.concat_arrays([no_line[0], pa.array(found.line, pa.int32())]),
                pa.concat_arrays([no_line[1], pa.array(found.nodes, pa.int64())]),
                *empty,
            )
    yield _counted(np.concatenate([words, pairs]))


def _sum_counts(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(SLOT_ROWS, np.int64)
    for low, high in zip(rows["low"].to_pylist(), rows["high"].to_pylist(), strict=True):
        total += np.frombuffer(low, np.uint8)
        at, rest = np.frombuffer(high, "<i8").reshape(2, -1)
        total[at] += rest
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _counts(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often words and word pairs of each slot are in all texts, from rows of SCANNED."""
    chunks = scanned.where("chunk is not null").select("chunk", "low", "high")
    counts = np.zeros(2 * SLOTS, np.int64)
    for chunk, n in chunks.groupBy("chunk").applyInArrow(_sum_counts, "chunk int, n binary").collect():
        counts[chunk * SLOT_ROWS : (chunk + 1) * SLOT_ROWS] = np.frombuffer(n, "<i8")
    return counts[:SLOTS], counts[SLOTS:]


def pair_counts(texts: DataFrame) -> np.ndarray:
    """How often word pairs of each slot are in the documents, all of them; any counts give the same links."""
    return _counts(texts.select("doc_id", "text").mapInArrow(_scan, SCANNED))[1]


def _name(order):
    """Packed rows of NAMED for every part: the word pairs that lines name, lines that a task has again left out."""

    def packed(parts: list[np.ndarray], named: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, rows = np.concatenate(parts), np.concatenate(named)
        data = rows[np.argsort(part, kind="stable")].tobytes()
        edges = np.append(0, np.cumsum(np.bincount(part, minlength=PARTS))) * NAMED.itemsize
        full = np.flatnonzero(np.diff(edges))
        blobs = [data[edges[i] : edges[i + 1]] for i in full.tolist()]
        yield _rows("part int, named binary", pa.array(full, pa.int32()), pa.array(blobs, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, waiting, seen = [], [], 0, set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for some in blocks(texts, LETTERS):
                found = Lines(texts[some])
                if len(seen) > 300_000:
                    seen.clear()
                # Adding tells what is new: a set grows.
                fresh_line = np.fromiter((len(seen) < (seen.add(x) or len(seen)) for x in found.nodes.tolist()), bool, len(found.nodes))
                fresh_line &= n_keys(found.sizes) > 0
                sizes, flat = found.sizes[fresh_line], found.flat[np.repeat(fresh_line, found.sizes)]
                if not len(sizes):
                    continue
                sims = np.bitwise_xor.reduceat(np.uint32(1) << (flat & np.uint64(31)).astype(np.uint32), np.cumsum(sizes) - sizes)
                nodes, short = found.nodes[fresh_line], np.minimum(sizes, LONG)
                for keys, line, need in line_keys(flat, sizes, order.value):
                    named = np.empty(len(keys), NAMED)
                    named["key"], named["need"], named["size"] = keys // np.uint64(PARTS), need, short[line]
                    named["node"], named["sim"] = nodes[line], sims[line]
                    parts.append((keys % np.uint64(PARTS)).astype(np.uint16))
                    rows.append(named)
                    waiting += len(named)
                if waiting >= PACKED:
                    yield from packed(parts, rows)
                    parts, rows, waiting = [], [], 0
        if waiting:
            yield from packed(parts, rows)

    return run


def _gathered(batches: Iterable[pa.RecordBatch], kind: np.dtype, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part, record) of whole parts, several parts together up to ``least`` bytes; rows come in order of parts."""
    parts, blobs, size = [], [], 0
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if size >= least and part != parts[-1]:
                yield np.repeat(parts, [len(x) // kind.itemsize for x in blobs]), np.frombuffer(b"".join(blobs), kind)
                parts, blobs, size = [], [], 0
            parts.append(part)
            blobs.append(blob)
            size += len(blob)
    if blobs:
        yield np.repeat(parts, [len(x) // kind.itemsize for x in blobs]), np.frombuffer(b"".join(blobs), kind)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _close(rows: np.ndarray, edges: np.ndarray, crowded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of rows of one bucket whose sizes and parities allow a link; rows of a bucket go up in size.

    Marks buckets as ``crowded`` once they have more than CROWD such pairs a row; their pairs count for nothing.
    """
    sizes, node, sim = rows["size"].astype(np.int64), rows["node"], rows["sim"]
    members = np.diff(edges)
    bucket, found = np.repeat(np.arange(len(members)), members), np.zeros(len(members), np.int64)
    behind = np.repeat(edges[1:], members) - np.arange(len(rows)) - 1
    behind[crowded[bucket]] = 0
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(behind) // SLICE)) + 1):
        after = np.where(crowded[bucket[at]], 0, behind[at])
        x = np.repeat(at, after)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
        longer, apart = sizes[y], sizes[y] - sizes[x]
        near = (apart <= longer * (100 - LEAST) // 100) & (np.bitwise_count(sim[x] ^ sim[y]) <= parted(longer, apart))
        near |= longer == LONG
        x, y = x[near], y[near]
        found += np.bincount(bucket[x], minlength=len(members))
        crowded |= found > CROWD * members
        left = ~crowded[bucket[x]]
        yield x[left], y[left]


def _pair_rows(a: np.ndarray, b: np.ndarray, met: np.ndarray, need: np.ndarray) -> np.ndarray:
    """PAIR rows, each pair once, by ``a`` and ``b``."""
    order = np.lexsort((b, a))
    a, b, met, need = a[order], b[order], met[order], need[order]
    first = np.flatnonzero(_changes(a, b))
    out = np.empty(len(first), PAIR)
    out["a"], out["b"], out["need"] = a[first], b[first], need[first]
    out["met"] = np.minimum(np.add.reduceat(met, first, dtype=np.int64), 255) if len(first) else 0
    return out


MET_ROWS = "part int, pairs binary, bucket long, node long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs of lines that name the same word pair, and rows (bucket, node) of buckets that hold too many."""

    def packed(pairs: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        found = _pair_rows(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        part = found["a"] % PAIR_PARTS
        order = np.argsort(part, kind="stable")
        data = found[order].tobytes()
        edges = np.append(0, np.cumsum(np.bincount(part, minlength=PAIR_PARTS))) * PAIR.itemsize
        full = np.flatnonzero(np.diff(edges))
        none = pa.nulls(len(full), pa.int64())
        blobs = [data[edges[i] : edges[i + 1]] for i in full.tolist()]
        yield _rows(MET_ROWS, pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), none, none)

    pairs, waiting = [], 0
    for part, rows in _gathered(batches, NAMED, GATHERED):
        key = part.astype(np.uint64) << np.uint64(_KEY_BITS)
        key |= rows["key"]
        order = np.argsort(key)
        again = ~_changes(key[order])
        order = order[again | np.append(again[1:], False)]
        key, rows = key[order], rows[order]
        order = np.lexsort((rows["node"], rows["size"], key))
        key, rows = key[order], rows[order]
        own = _changes(key, rows["node"])
        key, rows = key[own], rows[own]
        edges = np.append(np.flatnonzero(_changes(key)), len(key)) if len(key) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        crowded = sizes > WHOLE
        x, y = (np.concatenate(places) for places in zip(*_close(rows, edges, crowded), strict=True))
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        left = ~crowded[bucket[x]]
        x, y = x[left], y[left]
        a, b = rows["node"][x], rows["node"][y]
        need = np.minimum(rows["need"][x], rows["need"][y])
        pairs.append((np.minimum(a, b), np.maximum(a, b), np.ones(len(x), np.uint8), need))
        waiting += len(x)
        if waiting >= MET:
            yield from packed(pairs)
            pairs, waiting = [], 0
        many = np.repeat(crowded, sizes)
        if many.any():
            none = pa.nulls(int(many.sum()), pa.int32()), pa.nulls(int(many.sum()), pa.binary())
            yield _rows(MET_ROWS, *none, pa.array(key[many].astype(np.int64)), pa.array(rows["node"][many]))
    if waiting:
        yield from packed(pairs)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that met as often as they must, each once."""
    for _, rows in _gathered(batches, PAIR, GATHERED):
        found = _pair_rows(rows["a"], rows["b"], rows["met"], rows["need"])
        found = found[found["met"] >= found["need"]]
        yield _rows("a long, b long", pa.array(found["a"], pa.int64()), pa.array(found["b"], pa.int64()))


def within_edits(x: list[bytes], y: list[bytes], most: int) -> bool:
    """Whether at most ``most`` words are inserted, deleted or replaced; a step a word, once what is common at both ends is cut off."""
    if abs(len(x) - len(y)) > most:
        return False
    start = 0
    while start < len(x) and start < len(y) and x[start] == y[start]:
        start += 1
    x, y = x[start:], y[start:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if not x or not y:
        return max(len(x), len(y)) <= most
    # All rows of a column of the table of distances at once, as bits that say where it goes up and down.
    places: dict[bytes, int] = {}
    for i, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, edits, left = every, 0, len(x), len(y)
    for word in y:
        same = places.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(across | up)), up & across
        left -= 1
        if rise & last:
            edits += 1
            if edits - left > most:
                return False
        elif fall & last:
            edits -= 1
        rise, fall = (rise << 1 | 1) & every, (fall << 1) & every
        same |= down
        up, down = fall | (every & ~(same | rise)), rise & same
    return edits <= most


def similar(x: str, y: str) -> bool:
    a, b = line_words(x), line_words(y)
    most = max(len(a), len(b)) * (100 - LEAST) // 100
    of_a, of_b = set(a), set(b)
    # Every word that the other line does not have at all is an edit.
    if sum(w not in of_b for w in a) > most or sum(w not in of_a for w in b) > most:
        return False
    # So is every time that one has a word more often.
    if len(of_a) + most < len(a) and max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) > most:
        return False
    return within_edits(a, b, most)


def parted(longer, apart):
    """Words that only one of two similar lines has, at most: two for every edit, one for every word that is added."""
    return 2 * (longer * (100 - LEAST) // 100) - apart


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = pa.array([similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of words, LANES times 64 parities and COUNTS counts of words to lines (node, c, text).

    Counts beyond a byte are the same to all; where words come again and again, parities tell little.
    """
    hashes = WordHashes()
    for batch in batches:
        lines = [line_words(text) or [b""] for text in batch.column(2).to_pylist()]
        flat, sizes = _flat(lines, hashes)
        sims = np.zeros((len(lines), LANES), np.uint64)
        at = np.repeat(np.arange(len(lines)), sizes), ((flat >> np.uint64(6)) % np.uint64(LANES)).astype(np.int64)
        np.bitwise_xor.at(sims, at, np.uint64(1) << (flat & np.uint64(63)))
        counts = np.zeros((len(lines), COUNTS), np.int64)
        np.add.at(counts, (at[0], (flat >> np.uint64(16)).astype(np.int64) % COUNTS), 1)
        packed = (pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (sims, np.minimum(counts, 255).astype(np.uint8)))
        yield _rows(DESCRIBED, *batch.columns, pa.array(sizes, pa.int32()), *packed)


def _tile_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links that join components of two tiles of a bucket as far as there are any."""
    nodes, parts, names, sizes = (rows[c].to_numpy() for c in ("node", "part", "c", "words"))
    bits = np.zeros((len(nodes), len(nodes)), np.uint16)
    for sims in np.frombuffer(b"".join(rows["sims"].to_pylist()), np.uint64).reshape(-1, LANES).T:
        bits += np.bitwise_count(sims[:, None] ^ sims[None, :])
    near = bits <= parted(np.maximum(sizes[:, None], sizes[None, :]), np.abs(sizes[:, None] - sizes[None, :]))
    near &= names[:, None] < names[None, :]
    if key[1] != key[2]:
        near &= parts[:, None] != parts[None, :]
    x, y = np.nonzero(near)
    counts, few = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16), []
    for some in np.split(np.arange(len(x)), range(TILE_ROWS, len(x), TILE_ROWS)):
        few.append(np.abs(counts[x[some]] - counts[y[some]]).sum(axis=1, dtype=np.int64))
    few = np.concatenate(few) <= parted(np.maximum(sizes[x], sizes[y]), np.abs(sizes[x] - sizes[y]))
    texts, found, root = rows["text"].to_pylist(), [], {}

    def top(name: int) -> int:
        while (above := root.get(name, name)) != name:
            root[name] = name = root.get(above, above)
        return name

    for x, y in zip(x[few].tolist(), y[few].tolist(), strict=True):
        # What earlier links have joined needs no other one.
        if (one := top(int(names[x]))) != (other := top(int(names[y]))) and similar(texts[x], texts[y]):
            root[one] = other
            found.append(sorted((int(nodes[x]), int(nodes[y]))))
    low, high = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})


def drop_lists(documents: DataFrame) -> DataFrame:
    """One row per document id: doc_id, n_lines, dropped (numbers of lines that go, from 0, in order).

    Lines without a letter, digit or other non-ASCII character stay and link nothing. The first
    occurrence, by document id and line, of each group stays. Rows without an id take no part; rows
    that repeat an id count as one document. Null texts have no lines.
    """
    texts = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    spark = documents.sparkSession
    place = F.struct("doc_id", "line")
    scanned = stage(texts.mapInArrow(_scan, SCANNED), "lines")
    order = spark.sparkContext.broadcast(Order(*_counts(scanned)))
    named = texts.select("text").mapInArrow(_name(order), "part int, named binary")
    met = stage(named.repartition("part").sortWithinPartitions("part").mapInArrow(_meet, MET_ROWS), "met-lines")
    packed = met.where("part is not null").select("part", "pairs")
    pairs = stage(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_distinct, "a long, b long"), "line-pairs")
    shared = shared_buckets(met.where("bucket is not null").select("bucket", "node"))
    drop_staged(met)
    lines = scanned.where("line is not null").select("doc_id", "line", "node")
    classes = stage(lines.groupBy("node").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")), "line-classes")

    def line_texts(nodes: DataFrame, keep) -> DataFrame:
        wanted = keep(
            classes.join(nodes, "node").groupBy("at.doc_id").agg(F.collect_list(F.struct("at.line", "node")).alias("wanted")),
            "wanted-lines",
        )
        # One first occurrence of each wanted line, cut out where its text is read.
        found = texts.join(wanted, "doc_id").select(F.split("text", "\n").alias("parts"), F.explode("wanted").alias("w"))
        found = found.where("w.line < size(parts)").select("w.node", F.col("parts")[F.col("w.line")].alias("text"))
        return keep(found.groupBy("node").agg(F.min("text").alias("text")), "line-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")
        return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "line-links")

    def across(rows: DataFrame) -> DataFrame:
        nodes = rows.select("node", "c").distinct()
        lines_of = nodes.join(found, "node").select("node", "c", "text").mapInArrow(_describe, DESCRIBED)
        met = tiles_across(rows.withColumnRenamed("bucket", "family"), TILE_ROWS).join(lines_of, "node")
        return stage(met.groupBy("family", "i", "j").applyInArrow(_tile_links, "a long, b long").distinct(), "line-links")

    with scratch(spark, "line-texts") as keep:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.select("node")).distinct()
        found = line_texts(nodes, keep)
        linked = stage(link_pairs(pairs, shared, confirm, across), "line-components")
    # Only lines of several places or links can have an earlier one.
    grouped = classes.join(linked, "node").select("node", "at", "component")
    first = grouped.groupBy("component").agg(F.min("at").alias("first"))
    alone = classes.where("n > 1").join(linked, "node", "left_anti").select("node", F.col("at").alias("first"))
    kept = stage(grouped.join(first, "component").select("node", "first").unionByName(alone), "kept-lines")
    drop_staged(classes, linked)
    goes = lines.join(kept, "node").where(place != F.col("first")).groupBy(F.col("doc_id").alias("cut_id")).agg(
        F.array_sort(F.collect_set("line")).alias("dropped")
    )
    totals = scanned.where("doc_id is not null and line is null").groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    return totals.join(goes, F.col("doc_id") == F.col("cut_id"), "left").select("doc_id", "n_lines", dropped)


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """Documents without the lines that drop_lists names, with all their columns.

    A document that loses all its lines with words was a copy and goes; one that loses none stays as
    it is, empty or null texts and rows without an id included.
    """
    names = [fresh(f"lines_{name}", documents.columns) for name in ("id", "total", "dropped")]
    n_id, _, n_dropped = names
    lists = drop_lists(documents).where(F.size("dropped") > 0).toDF(*names)
    joined = documents.join(lists, F.col("doc_id") == F.col(n_id), "left")
    parts = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(n_dropped), i))
    cut = F.col(n_dropped).isNotNull() & F.col("text").isNotNull()
    text = F.when(cut, F.array_join(parts, "\n")).otherwise(F.col("text"))
    rest = joined.withColumn("text", text)
    # What is left has a letter, a digit or a character beyond ASCII.
    worded = F.col("text").rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]")
    return rest.where(~cut | F.coalesce(worded, F.lit(False))).select(*documents.columns)
