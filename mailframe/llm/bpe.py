"""BPE encoding and decoding with a public vocabulary of word-end tokens.

Each short word keeps a contiguous array of its parts and one of the ranks of adjacent pairs; the
lowest rank is found by a scan, one boundary goes, and the two neighbouring ranks are looked up anew.
Long words, where repeated scans would be quadratic, keep the same ranks in a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 30
SHORT = 64
CACHED_WORDS = 200_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Fixed values of this vocabulary's normaliser and splitter.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_WORD = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
# The same rule for texts of ASCII and the accented letters of Latin-1 only, where re is faster.
LATIN_WORD = re.compile(CONTRACTIONS + r"|[a-zA-ZÀ-ÖØ-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-zA-ZÀ-ÖØ-öø-ÿ0-9]+")
NOT_LATIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


@dataclass
class WordBpe:
    """The tables of a tokenizer file and the words met so far."""

    vocab: dict[str, int]
    ranks: dict[tuple[int, int], int]
    merged: list[int]
    specials: dict[str, int]
    suffix: str
    tokens: dict[int, str] = field(default_factory=dict)
    words: dict[str, tuple[bytes, str, int]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        out = cls(
            vocab,
            {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)},
            [vocab[a + b] for a, b in pairs],
            {t["content"]: t["id"] for t in spec["added_tokens"]},
            model["end_of_word_suffix"],
        )
        out.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in out.specials.items()}
        return out

    def merge_short(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        near = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while near:
            best = min(near)
            if best == NEVER:
                break
            i = near.index(best)
            parts[i] = self.merged[best]
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(near):
                near[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, leftmost of the lowest rank first, by a heap over linked parts."""
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [
            (r, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(pair)) is not None
        ]
        heapq.heapify(heap)

        def look(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                r = self.ranks.get((parts[i], parts[after[i]]))
                if r is not None:
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] < 0 or self.ranks.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(before[i])
            look(i)
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[bytes, str, int]:
        letters = [_LETTERS[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        parts = [self.vocab[x] for x in letters]
        parts = self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)
        found = (
            b"".join(i.to_bytes(4, "little") for i in parts), " ".join(self.tokens[i] for i in parts), len(parts)
        )
        if len(word) <= SHORT:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> tuple[int, bytes, str]:
        """Number of tokens, ids as little-endian 32-bit integers, and the decoded text."""
        ids: list[bytes] = []
        shown: list[str] = []
        count = 0
        known = self.words
        for piece in self._special.split(text):
            special = self.specials.get(piece)
            if special is not None:
                ids.append(special.to_bytes(4, "little"))
                shown.append(piece)
                count += 1
                continue
            for word in split_words(piece):
                found = known.get(word) or self.word(word)
                ids.append(found[0])
                shown.append(found[1])
                count += found[2]
        return count, b"".join(ids), " ".join(shown)

    @property
    def _special(self) -> re.Pattern:
        return _special_pattern(tuple(self.specials))


_LETTERS = byte_letters()


@lru_cache(4)
def _special_pattern(specials: tuple[str, ...]) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, specials)) + ")")


def split_words(text: str) -> list[str]:
    """Composed, lower-cased letter by letter, and split into words without white space."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    latin = not NOT_LATIN.search(text)
    if not latin:
        # Without context: a capital sigma is the same small letter at the end of a word too.
        text = text.replace("Σ", "σ")
    return (LATIN_WORD if latin else ANY_WORD).findall(text.lower())


def decode(ids: bytes, bpe: WordBpe) -> str:
    """The tokens of little-endian ids, between blanks, special ones included."""
    numbers = (int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4))
    return " ".join(bpe.tokens[i] for i in numbers if i in bpe.tokens)


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a tokenizer file that every executor has. A null text is empty: no tokens, and the
    digests of nothing. Special tokens written in a text are those tokens. Words of any length are
    encoded whole. Repeated rows are encoded each; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                n, raw, shown = bpe.encode(text)
                counts.append(n)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, SCHEMA)
