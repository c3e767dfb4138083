"""Alignment of two tokenizers against whole-text encodings and a walk over both sides."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailframe.llm import alignment
from mailframe.llm.bpe import byte_letters

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "  ", "a ", "foo  ", " foo", "foo \n bar", "foo\n\n", "\n", "x\n  \n y", "a\xa0 b", "▁x y", "a\0 b",
    "don't  do", "x" * 3000, "ab " * 900, "日本語 ΑΣ　x\xa0y", "éﬁ \xc5 z",
    "<|endoftext|> <s> a", "﻿ a b", "a​ b", "\u0085 b  c", "\t\t a", "\U0001f600 \U0001f44d\U0001f3fd ok",
    "a\x1c b", "Plain words, and some more.", "Plain words, and some more.",
]


@pytest.fixture(scope="module")
def walk():
    """Sizes, digest and id pairs of a text, token by token over whole encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(A)
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}

    def run(text):
        none = (0, 0, 0, 0, "", Counter())
        if not text:
            return none
        a, b = side_a.encode(" " + text, add_special_tokens=False), side_b.encode(text)
        bytes_a = [bytes(byte_of[x] for x in token) for token in a.tokens]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if side_b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(b, side_b.id_to_piece(b), strict=True)
        ]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return none
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        shown, pairs, i, j = [], Counter(), 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            left, right = [], []
            while i < len(ends_a) and ends_a[i] <= end:
                left.append(a.ids[i])
                i += 1
            while j < len(ends_b) and ends_b[j] <= end:
                right.append(b[j])
                j += 1
            shown.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            pairs.update((x, y) for x in left for y in right)
        return len(a.ids), len(b), len(shown), pairs.total(), hashlib.sha256(";".join(shown).encode()).hexdigest(), pairs

    return run


def expected(walk, rows):
    found = [walk(text) for _, text in rows]
    counts, best = Counter(), defaultdict(int)
    for *_, pairs in found:
        counts.update(pairs.keys())
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links, shown, pairs) in zip(rows, found, strict=True):
        n_best = sum(t for (x, y), t in pairs.items() if counts[x, y] == best[x])
        out.append((doc_id, n_a, n_b, groups, links, n_best, sum(t * counts[p] for p, t in pairs.items()), shown))
    return out


def result(documents, **settings):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [tuple(r) for r in alignment.align_documents(documents, A, B, **settings).select(columns).collect()]


def test_components_are_the_pieces_between_common_ends():
    rng = random.Random(1)
    for size in (1, 2, 3, 50, 400):
        cuts = [sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in range(2)]
        a, b, groups = alignment.component_labels(np.array(cuts[0]), np.array(cuts[1]))
        common = sorted(set(cuts[0]) & set(cuts[1]))
        assert groups == len(common)
        assert [int(x) for x in a] == [sum(c < e for c in common) for e in cuts[0]]
        assert [int(x) for x in b] == [sum(c < e for c in common) for e in cuts[1]]


def test_long_components_take_few_doublings():
    # Ends of one side lie between those of the other up to the last: one component of all tokens.
    a, b, groups = alignment.component_labels(np.append(np.arange(1, 20_001, 2), 20_002), np.arange(2, 20_003, 2))
    assert groups == 1 and not a.any() and not b.any()


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 3])
def test_alignment_equals_a_walk(spark, walk, hot):
    rows = list(enumerate(TEXTS)) + [(None, "Plain words"), (3, "Plain  words")]
    documents = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a long, key string")
    assert sorted(result(documents, hot=hot), key=str) == sorted(expected(walk, rows), key=str)


def test_rows_of_many_pairs_go_on_in_parts(spark, walk, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_PAIRS", 2)
    aligner = alignment.Aligner(A, B)
    batch = alignment._align_rows(A, B)
    assert batch and aligner.cuts
    rows = [(1, "several words make several pairs"), (2, "several more")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(result(documents)) == sorted(expected(walk, rows))


def test_stretches_are_met_again_and_forgotten(walk, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_STRETCHES", 5)
    monkeypatch.setattr(alignment, "ROW_STRETCHES", 3)
    aligner = alignment.Aligner(A, B)
    for _ in range(3):
        for text, (*found, keys, times) in zip(TEXTS, aligner.align(TEXTS), strict=True):
            *sizes, pairs = walk(text)
            assert (*found, dict(zip(keys.tolist(), times.tolist(), strict=True))) == (
                *sizes, {x * len(aligner.bytes_b) + y: t for (x, y), t in pairs.items()}
            )


def test_no_documents(none):
    assert result(none) == []


def test_odd_documents(odd, walk):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(result(odd), key=str) == sorted(expected(walk, rows), key=str)
