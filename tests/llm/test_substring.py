"""Substring dedup against all windows by brute force."""

import os
import random
import re

import numpy as np
import pytest

from mailframe.llm import substring

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, window=substring.WINDOW):
    split = [(doc_id, WORD.findall(text or "")) for doc_id, text in rows]
    first = {}
    for doc_id, words in split:
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, words in split:
        gone = set()
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            if first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def result(documents, *window):
    columns = ["doc_id", "n_words", "n_removed", "kept"]
    return sorted((tuple(r) for r in substring.drop_repeats(documents, *window).select(columns).collect()), key=str)


def random_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([2, 3, 10, 300]))]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(25)]
    for _ in range(15):
        source, target = rng.randrange(25), rng.randrange(25)
        copied = rows[source][1].split()[rng.randint(0, 20) :][: rng.choice([12, 13, 14, 40])]
        own = rows[target][1].split()
        at = rng.randint(0, len(own))
        rows[target] = (target, " ".join(own[:at] + copied + own[at:]))
    rows += [(30, "a " * 60), (31, "a " * 13), (32, "a b " * 40), (33, "b a " * 9), (34, None), (35, "\n\t ")]
    return rows


@pytest.mark.parametrize("window", [1, 2, 5, 13, 50])
def test_equal_windows_take_equal_symbols(window):
    for seed in range(6):
        texts = [(text or "").encode().split() for _, text in random_rows(seed)]
        names, wall, begin = substring.lay_out(texts, substring.WordNames())
        starts, symbols = substring._windows(names, wall, window)
        assert len(starts) == sum(max(0, len(x) - window + 1) for x in texts)
        seen = {}
        for start, symbol in zip(starts.tolist(), symbols.tolist(), strict=True):
            text = int(np.searchsorted(begin, start, "right")) - 1
            words = tuple(texts[text][start - begin[text] :][:window])
            assert len(words) == window
            assert seen.setdefault(words, symbol) == symbol


def test_higher_symbols_span_several_words():
    rng = random.Random(4)
    texts = [[b"w%d" % rng.randrange(1000) for _ in range(4000)]]
    names, wall, _ = substring.lay_out(texts, substring.WordNames())
    order = substring.symbol_order(names, wall, 24)
    rounds = 15 - (order[~wall] >> np.uint64(60)).astype(int)
    assert {0, 1, 2} <= set(rounds.tolist())
    _, symbols = substring._windows(names, wall, 48)
    # Neighbouring windows mostly take the same symbol.
    assert len(np.unique(symbols)) < len(symbols) / 8


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    rows = random_rows(seed)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_other_windows(spark):
    rows = random_rows(7)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (4, 30):
        assert result(documents, window) == expected(rows, window)


def test_blocks_of_any_size(spark, monkeypatch):
    rows = random_rows(8)
    texts = [(text or "").encode().split() for _, text in rows]
    whole = substring.lay_out(texts, substring.WordNames())
    expected_symbols = substring._windows(whole[0], whole[1], 13)[1].tolist()
    alone = []
    for text in texts:
        names, wall, _ = substring.lay_out([text], substring.WordNames())
        alone += substring._windows(names, wall, 13)[1].tolist()
    assert alone == expected_symbols


def test_odd_documents(odd):
    assert result(odd) == expected([(r.doc_id, r.text) for r in odd.collect()])


def test_repeated_ids_and_rows_without_id(spark):
    words = " ".join(f"u{i}" for i in range(20))
    rows = [(1, words), (1, words), (1, words + " more"), (None, words), (None, words), (2, "x " + words)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_no_documents(none):
    assert result(none) == []


@needs_data
def test_given_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = result(documents)
    assert found == expected(rows)
    assert sum(r[2] for r in found) > 0
